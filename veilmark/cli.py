"""Command line: python -m veilmark.cli -i IN -o OUT [...]. Exit codes: 0 done, 1 identifiers left, 3 anything else.

IN is a path, a folder or a pattern that Spark reads. Of one archive OUT is the file; of several it is a folder
with a file of the same name for each, and one key serves all of them.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions.keys import REDACT, Key
from .functions.timeshift import parse_duration
from .kinds import PolicyError, ResidualPiiError
from .operators import audit, vault
from .plans.policy import Options, describe
from .sources.archives import read_archives


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilmark", description=__doc__)
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("--profile", default="balanced")
    p.add_argument("--only")
    p.add_argument("--entity", action="append", default=[])
    p.add_argument("--key-file")
    p.add_argument("--passphrase")
    p.add_argument("--vault")
    p.add_argument("--logarchive", choices=("drop", "jsonl"), default="drop")
    p.add_argument("--time-shift", type=parse_duration)
    p.add_argument("--drop-text-from-packages", type=lambda x: [y.strip() for y in x.split(",") if y.strip()], default=[])
    for flag in ("contract-test", "list-entities", "reversible", "restore", "explain", "verify", "i-understand", "ordinal", "keep-location", "keep-cell-ids", "generalize-carrier", "drop-carrier", "pseudo-third-party-packages"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def options_of(a: argparse.Namespace) -> Options:
    return Options(a.profile, a.only, tuple(a.entity), "encrypt" if a.reversible else "pseudonym", a.logarchive, a.ordinal, a.time_shift, keep_location=a.keep_location, keep_cell_ids=a.keep_cell_ids, generalize_carrier=a.generalize_carrier, drop_carrier=a.drop_carrier, pseudo_third_party_packages=a.pseudo_third_party_packages, drop_text_from_packages=tuple(a.drop_text_from_packages))


def key_of(a: argparse.Namespace, archive_id: str | None) -> Key:
    if a.key_file:
        with open(a.key_file, "rb") as f:
            return Key.from_file(f.read())
    if a.passphrase:
        return Key.from_passphrase(a.passphrase, archive_id)
    if a.reversible or a.restore:
        raise PolicyError("sealing and restoring need --key-file or --passphrase")
    return Key.random()


def run(argv: list[str]) -> int:
    a = parser().parse_args(argv)
    options = options_of(a)
    if a.list_entities:
        print(describe(options))
        return 0
    if a.contract_test:
        print("the contract is checked by the tests: python -m pytest tests/")
        return 0
    if not a.input:
        raise PolicyError("-i is needed")
    spark = SparkSession.builder.config("spark.sql.redaction.string.regex", REDACT).getOrCreate()
    archives = read_archives(spark, a.input)
    if a.explain:
        print("\n".join(r.line for r in engine.explain_archives(archives, options).collect()))
        return 0
    if a.verify:
        left = engine.verify_archives(archives, options).groupBy("kind").count().orderBy("kind").collect()
        print("\n".join(f"{r[0]}: {r[1]}" for r in left) or "clean")
        return int(bool(left))
    if not a.output:
        raise PolicyError("-o is needed")
    if a.vault and not a.i_understand:
        raise PolicyError("a vault can undo the run: say --i-understand")
    names = dict(archives.select("archive_id", "path").orderBy("path").collect())  # a row for each archive
    if not names:
        raise PolicyError("there is no archive to read")
    key = key_of(a, next(iter(names)) if len(names) == 1 and not (a.reversible or a.restore) else None)
    done = None if a.restore else engine.anonymize_archives(archives, key, options)
    where = {k: a.output if len(names) == 1 else os.path.join(a.output, os.path.basename(path)) for k, path in names.items()}
    if len(set(where.values())) < len(where):
        raise PolicyError("archives of one name in several folders need runs of their own")
    if len(names) > 1:
        os.makedirs(a.output, exist_ok=True)
    for row in (engine.restore_archives(archives, key) if a.restore else done.archives).select("archive_id", "content").toLocalIterator():
        with open(where[row["archive_id"]], "wb") as f:
            f.write(bytes(row["content"]))
    if done:
        for row in done.report.select("archive_id", "report_json", audit.markdown(F.col("report")).alias("md")).toLocalIterator():
            stem = os.path.splitext(where[row["archive_id"]])[0]
            for name, text in ((f"{stem}-report.json", row["report_json"]), (f"{stem}-report.md", row["md"])):
                with open(name, "w", encoding="utf-8") as f:
                    f.write(text)
        if a.vault:
            vault.write_vault(done.mapping, a.vault, a.passphrase or os.environ.get("VEILMARK_VAULT_PASSPHRASE", ""), next(iter(where.values())))
    return 0


def main() -> None:
    try:
        sys.exit(run(sys.argv[1:]))
    except ResidualPiiError as e:
        print(e, file=sys.stderr)
        sys.exit(1)
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        sys.exit(3)


if __name__ == "__main__":
    main()
