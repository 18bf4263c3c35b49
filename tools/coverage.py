"""Print the inventory coverage table (Markdown): id -> queries, and how each is checked."""

from __future__ import annotations

import collections
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.registry import load_all  # noqa: E402


def main():
    by_id = collections.defaultdict(list)
    for name, e in load_all().items():
        for ident in e.covers.split():
            by_id[ident].append(f"`{name}`" + ("" if e.sql else " (rows only)"))
    order = lambda i: (re.sub(r"\d", "", i), int(re.sub(r"\D", "", i)))
    print("# Coverage of the operator inventory\n\nEach id of section 2 of the survey and the registered queries that")
    print("exercise it. Queries without a note are compared with SQL.\n\n| id | queries |\n|---|---|")
    for ident in sorted(by_id, key=order):
        print(f"| {ident} | {', '.join(by_id[ident])} |")


if __name__ == "__main__":
    main()
