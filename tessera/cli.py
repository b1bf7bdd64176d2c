"""python -m tessera.cli PATH COMMAND ...: the facade on a saved knowledge base."""

from __future__ import annotations

import argparse

from tessera import presentation as P
from tessera.api import KnowledgeBase
from tessera.session import session


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("path")
    sub = p.add_subparsers(dest="command", required=True)
    for name, arg in (("search", "query"), ("suggest", "word"), ("read", "id"), ("graph", "start"), ("tree", "entity")):
        s = sub.add_parser(name)
        s.add_argument(arg)
        if name == "graph":
            s.add_argument("--depth", type=int, default=2)
    b = sub.add_parser("budget")
    b.add_argument("query")
    b.add_argument("tokens", type=int)
    for name in ("topics", "timeline", "recent", "status", "quality", "diagnose", "recommend", "index"):
        sub.add_parser(name)
    a = p.parse_args(argv)
    kb = KnowledgeBase.load(session("tessera-cli"), a.path)
    run = {
        "search": lambda: kb.search(a.query), "suggest": lambda: kb.suggest(a.word), "read": lambda: kb.read(a.id), "graph": lambda: kb.graph(a.start, a.depth), "topics": kb.topics, "timeline": kb.timeline,
        "recent": kb.recent, "status": kb.status, "quality": kb.quality, "diagnose": kb.diagnose, "recommend": kb.recommend, "budget": lambda: kb.context_budget(a.query, a.tokens),
    }
    if a.command == "index":
        print(P.memory_index(kb.entities))
    elif a.command == "tree":
        print(P.tree(kb.entity_atoms(a.entity)))
    else:
        print(P.table(run[a.command]()))


if __name__ == "__main__":
    main()
