"""Commands on folders of files: plan, build, restore, encrypt, decrypt, scan."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from veilspark.operators import crypto, governance, planning, redact
from veilspark.operators.package import public_package, redact_projects, write_package
from veilspark.session import build_session
from veilspark.sources import readers


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (("plan", "root"), ("build", "root", "out"), ("restore", "mapping", "text"), ("encrypt", "mapping", "out"), ("decrypt", "mapping", "out"), ("scan", "root")):
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
        if name in ("encrypt", "decrypt"):
            s.add_argument("--passphrase-fd", type=int, help="open file descriptor to read the passphrase from; else $VEILSPARK_PASSPHRASE")
        if name == "build":
            s.add_argument("--dictionary")
            s.add_argument("--decisions")
    a = p.parse_args(argv)
    spark = build_session()
    if a.command == "plan":
        plan = planning.input_plan(readers.list_files(spark, a.root), "path")
        print(json.dumps(planning.plan_status(plan).first().asDict()))
    elif a.command == "build":
        build(spark, a.root, a.out, a.dictionary, a.decisions)
    elif a.command == "restore":
        items = json.load(open(a.mapping, encoding="utf-8"))["items"]
        pairs = [(i["replacement"], i["original"]) for i in items if i["replacement"] != i["placeholder"]] + [(i["placeholder"], i["original"]) for i in items]
        sys.stdout.write(redact.Replacer(pairs)(open(a.text, encoding="utf-8").read()))
    elif a.command == "encrypt":
        crypto.write_private(a.out, crypto.encrypt(spark, json.load(open(a.mapping, encoding="utf-8")), _passphrase(a.passphrase_fd)), a.mapping)
    elif a.command == "decrypt":
        crypto.write_private(a.out, crypto.decrypt(spark, json.load(open(a.mapping, encoding="utf-8")), _passphrase(a.passphrase_fd)))
    elif a.command == "scan":
        t = readers.blocks(readers.read_files(spark, a.root)).select(F.concat("project_id", F.lit("/"), "file_name").alias("file"), "text")
        hits = governance.secret_scan(t, "file", "text")
        for r in hits.toLocalIterator():
            print(f"{r['file']}:{r['line']}")
    return 0


def build(spark, root: str, out: str, dictionary: str | None = None, decisions: str | None = None) -> None:
    """All projects below a folder, one folder each, to packages."""
    files = readers.read_files(spark, root)
    b = readers.blocks(files)
    texts = b.select("project_id", F.struct("file_ord", "block_ord").alias("block"), "text")
    given = files.select("project_id").distinct()
    x = readers.read_decisions(spark, decisions, given) if decisions else None
    d = readers.read_dictionary(spark, dictionary, given) if dictionary else None
    r = redact_projects(texts, "block", x, d, readers.channel_texts(files))
    write_package(r, public_package(r, "block", readers.manifest(files), x, readers.channel_status(files)), out, x)


def _passphrase(fd: int | None) -> str:
    """From an open file or the environment: arguments of a process can be seen by others."""
    if fd is not None:
        with os.fdopen(fd, encoding="utf-8") as f:
            return f.readline().rstrip("\n")
    return os.environ.get("VEILSPARK_PASSPHRASE", "")


if __name__ == "__main__":
    raise SystemExit(main())
