"""python -m lexloom init|drop|stats|validate|backup|restore PATH: a store from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from lexloom.operators import stats, validate
from lexloom.session import session
from lexloom.sources.store import Store, open_store


def main(arguments: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lexloom")
    p.add_argument("action", choices=["init", "drop", "stats", "validate", "backup", "restore"])
    p.add_argument("path")
    p.add_argument("--force", action="store_true", help="init: empty a store that is there")
    p.add_argument("--confirm", action="store_true", help="drop: do it")
    p.add_argument("--backup-to", help="drop, backup, restore: the folder of copies")
    p.add_argument("--id", help="restore: which copy; the newest without it")
    a = p.parse_args(arguments)
    spark = spark or session()
    store = Store(spark, a.path)
    try:
        if a.action == "init":
            if store.exists() and not a.force:
                raise ValueError("there is a store already; --force empties it")
            out = {"version": store.create(force=a.force).version}
        elif a.action == "drop":
            store.drop(confirm=a.confirm, backup_to=a.backup_to)
            out = {"dropped": a.path}
        elif a.action == "stats":
            out = {r["name"]: r["rows"] for r in stats.table_stats(open_store(spark, a.path).tables()).collect()}
        elif a.action == "validate":
            out = validate.summary(validate.validate(open_store(spark, a.path).tables())).first().asDict()
        elif a.action == "backup":
            out = open_store(spark, a.path).backup(folder=a.backup_to)
        else:
            copies = [e for e in store.backups(a.backup_to) if e["success"] and a.id in (None, e["id"])]
            if not copies:
                raise ValueError("no such copy")
            out = {"version": store.restore(copies[0]["id"], a.backup_to)}
    except ValueError as e:
        print(f"lexloom: {e}", file=sys.stderr)
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main())
