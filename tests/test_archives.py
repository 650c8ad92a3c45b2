"""Archives end to end: no planted value survives, equal values stay equal, seals open again."""

import io
import json
import lzma
import plistlib
import sqlite3
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from veilmark import engine, queries, queries_runs
from veilmark.functions.keys import Key
from veilmark.kinds import ResidualPiiError, UnsupportedArchive
from veilmark.operators import vault
from veilmark.plans.policy import Options
from veilmark.sources import archives as containers
from veilmark.sources import leaves

KEY = Key(b"\x07" * 32)
DUMP = """written by a tool, before any section
DUMP OF SERVICE package:
  Package [org.quill.notes]
DUMP OF SERVICE iphonesubinfo:
  slot 0, IMEI: 490154203237518
DUMP OF SERVICE location:
  last {gps, 47.250003,-8.500004±3.0m, extras}
DUMP OF SERVICE wifi:
  BSSID: aa:bb:cc:dd:ee:ff
  SSID: "Quill House"
DUMP OF SERVICE account:
  Account {name=ida.quill@post.example.org, type=com.google}
DUMP OF SERVICE user:
  UserInfo{10:Ida Quill:1043}
01-09 07:15:21.250 W web: account ida.quill%40post.example.org of Ida Quill
"""
PLANTED = ("ida.quill", "post.example", "Ida Quill", "Quill House", "aa:bb:cc:dd:ee:ff", "47.250003", "490154203237518")


def proto(text):
    b = text.encode()
    return bytes([10, len(b)]) + b + bytes([16, 7])


def database():
    db = sqlite3.connect(":memory:")
    db.execute("create table accounts (id integer primary key, email text, n int)")
    db.executemany("insert into accounts (email, n) values (?, ?)", [("ida.quill@post.example.org", 1), (None, 2)])
    db.commit()
    return db.serialize()


FILES = {
    "dumpstate.txt": DUMP.encode(),
    "version.txt": b"2.0\n",
    "screen.PNG": b"\x89PNG\r\n",
    "wifi.plist": plistlib.dumps({"list": [{"SSID": "Quill House", "n": 3}], "note": "by ida.quill@post.example.org"}),
    "wifi.bin.plist": plistlib.dumps({"SSID": "Quill House"}, fmt=plistlib.FMT_BINARY),
    "acc.db": database(),
    "proto/a.pb": proto("mail ida.quill@post.example.org"),
    "crash.ips": (json.dumps({"b": 1, "a": 2}) + "\n" + json.dumps({"email": "ida.quill@post.example.org", "id": "550e8400-e29b-41d4-a716-446655440000"})).encode(),
    "blob.bin": b"\xff\xfe\x00\x01",
}


def zipped(files):
    return containers.zip_bytes(list(files.items()))


def frame(spark, *contents):
    df = spark.createDataFrame([(bytearray(c),) for c in contents], "content binary")
    return df.select(F.sha2("content", 256).alias("archive_id"), containers.archive_kind(F.col("content")).alias("kind"), F.octet_length("content").cast("bigint").alias("n_bytes"), "content")


def opened(run):
    return dict(containers.members_of(bytes(run.archives.first()["content"]), run.archives.first()["kind"]))


@pytest.fixture(scope="module")
def run(spark):
    return engine.anonymize_archives(frame(spark, zipped(FILES)), KEY)


def test_nothing_planted_survives(run):
    out = opened(run)
    assert "screen.PNG" not in out and "blob.bin" not in out
    for name, data in out.items():
        for p in PLANTED:
            assert p.encode() not in data, (name, p)


def test_equal_values_stay_equal(run):
    out = opened(run)
    mail = sqlite3.connect(":memory:")
    mail.deserialize(out["acc.db"])
    (made,) = mail.execute("select email from accounts where id = 1").fetchone()
    assert made.endswith(".invalid") and made in out["dumpstate.txt"].decode() and made in out["crash.ips"].decode()
    assert plistlib.loads(out["wifi.plist"])["list"][0]["SSID"] == plistlib.loads(out["wifi.bin.plist"])["SSID"]
    assert f'"{plistlib.loads(out["wifi.bin.plist"])["SSID"]}"' in out["dumpstate.txt"].decode()
    assert out["wifi.bin.plist"][:6] == b"bplist" and list(json.loads(out["crash.ips"].decode().split("\n")[0])) == ["b", "a"]
    assert leaves.protobuf_fields(out["proto/a.pb"])[1] == (2, 0, b"\x07")
    assert out["version.txt"] == FILES["version.txt"] and b"org.quill.notes" in out["dumpstate.txt"]


def test_report(run):
    report = json.loads(run.report.first()["report_json"])
    assert report["residual_scan"]["status"] == "clean" and "gps.dropped" in report["declared_divergences"]
    assert not any(p in run.report.first()["report_json"] for p in PLANTED)
    assert {m["path"] for m in report["members_dropped"]} == {"screen.PNG", "blob.bin"}


def test_repeatable_and_key_dependent(spark, run):
    small = frame(spark, zipped({"dumpstate.txt": FILES["dumpstate.txt"]}))
    a, b = (engine.anonymize_archives(small, k).archives.first()["content"] for k in (KEY, Key(b"\x09" * 32)))
    assert a == engine.anonymize_archives(small, KEY).archives.first()["content"] != b


def test_seal_and_restore(spark):
    options = Options(mode="encrypt", entity=("location=pseudo",), profile="research")
    files = {k: FILES[k] for k in ("dumpstate.txt", "wifi.plist", "acc.db", "proto/a.pb")}
    sealed = engine.anonymize_archives(frame(spark, zipped(files)), KEY, options)
    out = opened(sealed)
    assert b"ida.quill" not in out["dumpstate.txt"] and b"vm1." in out["dumpstate.txt"] and b"vm1." in out["proto/a.pb"]
    back = engine.restore_archives(sealed.archives, KEY).first()
    restored = dict(containers.members_of(bytes(back["content"]), back["kind"]))
    assert b"Account {name=ida.quill@post.example.org" in restored["dumpstate.txt"] and back["n_opened"] > 3
    assert restored["proto/a.pb"] == files["proto/a.pb"] and plistlib.loads(restored["wifi.plist"]) == plistlib.loads(files["wifi.plist"])
    with pytest.raises(Exception, match="does not open"):
        engine.restore_archives(sealed.archives, Key(b"\x01" * 32)).collect()


def test_gate_withholds_and_research_warns(spark):
    text = "DUMP OF SERVICE x:\nnear de:ad:be:ef:00:01\n"
    left = frame(spark, zipped({"dumpstate.txt": text.encode()}))
    found = engine.verify_archives(left)
    assert [r.kind for r in found.collect()] == ["mac_address"]
    # an action that leaves the value makes the gate fail, but kept kinds are exempt
    assert engine.anonymize_archives(left, KEY, Options(entity=("mac=keep",))).status.first()["status"] == "clean"
    weird = frame(spark, zipped({"dumpstate.txt": b"DUMP OF SERVICE x:\npos 52.123456, 4.123456\n"}))
    with pytest.raises(ResidualPiiError):
        engine.anonymize_archives(weird, KEY)


def test_tar_archives(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in (("sysdiagnose_1/ps.txt", b"x"), ("sysdiagnose_1/._ps.txt", b"y"), ("sysdiagnose_1/logs/Safari/History.db", b"z"), ("sysdiagnose_1/wifi.plist", FILES["wifi.plist"])):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    done = engine.anonymize_archives(frame(spark, lzma.compress(out.getvalue())), KEY)
    assert sorted(opened(done)) == ["ps.txt", "wifi.plist"] and done.archives.first()["kind"] == "apple"
    with pytest.raises(UnsupportedArchive):
        containers.members_of(b"neither", "auto")


def test_explain(spark):
    lines = [r.line for r in engine.explain_archives(frame(spark, zipped(FILES))).collect()]
    assert any(x.startswith("DROP screen.PNG") for x in lines) and any(x.startswith("imei x1 -> pseudo (high)") for x in lines)


def test_table_mode(spark):
    docs = spark.createDataFrame([(1, "mail a@b.org +49 30 1234567"), (2, "again A@b.org"), (3, None), (4, "")], "id int, text string")
    run = engine.anonymize_table(docs, ["id"], ["text"], key=KEY, options=Options(profile="strict"))
    rows = dict(run.rewritten.collect())
    assert rows[3] is None and rows[4] == "" and "a@b.org" not in rows[1] and rows[2].lower().split()[1] == rows[1].split()[1]
    by_row = dict(docs.select("id", engine.pseudonymize_column(F.col("text"), KEY, Options(profile="strict"))).collect())
    assert by_row == rows


def test_vault(spark, tmp_path):
    made = spark.createDataFrame([("email", "a@b.org", "x@y.invalid")], "kind string, canonical string, replacement string")
    (tmp_path / "v").mkdir()
    import veilmark.functions.keys as keys

    slow, keys.MEMORY_KIB = keys.argon2id, 64
    vault.argon2id = lambda p, s: slow(p, s, memory=64)
    try:
        vault.write_vault(made, str(tmp_path / "v" / "vault"), "secret", str(tmp_path / "out.zip"))
        assert vault.read_vault(spark, str(tmp_path / "v" / "vault"), "secret").collect() == made.collect()
        with pytest.raises(vault.VaultError):
            vault.read_vault(spark, str(tmp_path / "v" / "vault"), "wrong")
        with pytest.raises(vault.VaultError):
            vault.write_vault(made, str(tmp_path / "w"), "secret", str(tmp_path / "out.zip"))
    finally:
        vault.argon2id, keys.MEMORY_KIB = slow, 19_456


def test_read_archives_from_files(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"version.txt": b"1"}))
    row = containers.read_archives(spark, str(tmp_path / "a.zip")).first()
    assert row["kind"] == "android" and zipfile.is_zipfile(io.BytesIO(bytes(row["content"])))


def test_members_meet_their_surfaces_in_shares(spark, monkeypatch):
    """Many members with many surfaces: each member's own address and that of the one before, in text, a crash report and a plist."""
    monkeypatch.setattr(engine, "SHARE", 4000)
    name = lambda i: f"person{i}@corp{i % 7}.example.com"
    files = {f"logs/c{i}.txt": f"mail {name(i)} and {name(max(i - 1, 0))}\n".encode() for i in range(300)}
    files["crash.ips"] = f"pid 1\nmemory near r0:\n    0000 {name(7)}\nend".encode()
    files["a.plist"] = plistlib.dumps({"email": name(8)})
    done = engine.anonymize_archives(frame(spark, zipped(files)), KEY, Options(profile="strict"))
    made = {r["canonical"]: r["replacement"] for r in done.mapping.collect()}
    got = opened(done)
    assert len(made) == 300 and list(got) == list(files)
    assert all(got[f"logs/c{i}.txt"].decode() == f"mail {made[name(i)]} and {made[name(max(i - 1, 0))]}\n" for i in range(300))
    assert got["crash.ips"].decode() == f"pid 1\n{leaves.DUMP_NOTE}\nend" and plistlib.loads(got["a.plist"]) == {"email": made[name(8)]}


def test_surfaces_are_not_joined_to_each_member(spark):
    rows = spark.range(500).select(F.lit("a").alias("archive_id"), F.concat(F.lit("m"), "id").alias("member"), F.lit("text").alias("handler"), F.concat(F.lit("see <"), "id", F.lit(">")).cast("binary").alias("content"))
    surfaces = spark.range(500).select(F.lit("a").alias("archive_id"), F.concat(F.lit("<"), "id", F.lit(">")).alias("surface"), F.concat(F.lit("n"), "id").alias("replacement"))
    new = engine.rewrite_members(rows, surfaces, Options())
    assert {(r["member"], bytes(r["content"]).decode()) for r in new.collect()} == {(f"m{i}", f"see n{i}") for i in range(500)} and new.columns == rows.columns


def test_many_small_databases_are_dealt_to_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_runs, "PER_TASK", 10)
    spark.range(45).selectExpr("id as c_custkey", "concat('Customer#', id) as c_name", "cast(id % 25 as int) as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    rows = queries.queries()["sqlite_values"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 5
    assert {(r["id"], r["text"]) for r in rows.where("key_path = 'people.name'").collect()} == {(i, f"CUSTOMER#{i}") for i in range(45)}
