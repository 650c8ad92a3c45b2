"""Detectors, generators, seals and policies against known answers and plain Python."""

import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from veilmark.functions import detect, encodings, pseudonym, seal, structural, timeshift
from veilmark.functions.keys import Key, argon2id
from veilmark.kinds import PolicyError
from veilmark.plans import policy

KEY = Key(b"\x07" * 32)
KNOWN = [
    ("email", "a@b.com", "user-9bc0a582@corp-f3ce.invalid"),
    ("imei", "490154203237518", "108643982850602"),
    ("bssid", "aa:bb:cc:dd:ee:ff", "02:1d:27:c2:2e:cd"),
    ("ipv4_public", "8.8.8.8", "198.51.100.77"),
    ("phone_number", "+33123456789", "+35553785230"),
    ("uuid", "550e8400-e29b-41d4-a716-446655440000", "c33b3150-d53d-4678-e9fa-d15e220d8d7f"),
    ("bluetooth_name", "Anthony's AirPods", "BT-Device-8b16 (AirPods)"),
]


def made(spark, rows, key=KEY):
    df = spark.createDataFrame([(k, v) for k, v in rows], "kind string, v string")
    return [r[0] for r in df.select(pseudonym.pseudonym(F.col("kind"), F.col("v"), key.tag(F.col("kind"), F.col("v")))).collect()]


def test_known_pseudonyms(spark):
    assert made(spark, [(k, v) for k, v, _ in KNOWN]) == [p for _, _, p in KNOWN]


def test_tag_is_hmac(spark):
    got = spark.range(1).select(KEY.tag(F.lit("email"), F.lit("ä@b.com"))).first()[0]
    assert got == hmac.new(KEY.raw, "email|ä@b.com".encode(), hashlib.sha256).hexdigest()


def test_every_kind_keeps_its_shape_and_depends_on_the_key(spark):
    rows = [("email", f"u{i}@x.org") for i in range(300)] + [("imei", "490154203237518"), ("serial_number", "Ab3-9Z"), ("udid", "a" * 40), ("ssid", "é"), ("imsi", "262011234567890")]
    a, b = made(spark, rows), made(spark, rows, Key(b"\x08" * 32))
    assert len(set(a[:300])) == 300 and not set(a[:300]) & set(b[:300])
    assert a == made(spark, rows)
    assert re.fullmatch(r"[A-Z][a-z]\d-\d[A-Z]", a[301]) and len(a[302]) == 40 and len(a[303]) == 7 and len(a[304]) == 15
    shapes = spark.createDataFrame([(k, p) for (k, _), p in zip(rows, a, strict=True) if k in ("email", "ssid")], "k string, p string")
    assert all(r[0] for r in shapes.select(pseudonym.is_pseudonym(F.col("k"), F.col("p"))).collect())


U = "550e8400-e29b-41d4-a716-446655440000"
#: (text, section, key path): the hits that are expected, as far as they are told
SCANS = [
    (("to a.B@c.org now", None, None), [("email", "a.B@c.org", "a.b@c.org", 0, 3, 12)]),
    (("to a.B@c.org now", "log", None), [("email", "a.B@c.org", "a.b@c.org", 2, 3, 12)]),
    (("to a.B@c.org now", None, "x.y"), [("email", "a.B@c.org", "a.b@c.org", 2, 3, 12)]),
    (("x@2x.png user-1@corp-1.invalid", None, None), []),
    (("ö 490154203237518 490154203237519", None, None), [("imei", "490154203237518", "490154203237518", 0, 2, 17)]),
    (("10.1.2.3 8.8.8.8 198.51.100.7\nversion 1.2.3.4 v5.6.7.8", None, None), [("ipv4_private", "10.1.2.3"), ("ipv4_public", "8.8.8.8")]),
    ((f"/Containers/{U} {U}", None, None), [("container_uuid", U), ("uuid", U)]),
    ((f"{' ' * 50}{U}", None, None), [("uuid", U, U, 1)]),
    (("11:22:33:44:55:66", None, None), []),
    (("11:22:33:44:55:66", "wifi", None), [("bssid", "11:22:33:44:55:66")]),
    (("02:aa:33:44:55:66 ff:ff:ff:ff:ff:ff", None, None), []),
    (("at 52.3920, -4.90000", None, None), [("gps_coordinate", "52.3920, -4.90000", "52.392,-4.9", 1)]),
    (("at 152.3920, -4.90000", None, None), []),
    (("call +49 (30) 123-4567 or +12345", None, None), [("phone_number", "+49 (30) 123-4567", "+49301234567", 0)]),
    (("Account {name=Bob, type=x}", "account", None), [("user_name", "Bob", "bob", 2, 14, 17)]),
    (("UserInfo{0:I:13}\nOwner name: I \r\n", "user", None), [("user_name", "I", "I", 2, 11, 12), ("user_name", "I", "I", 2, 29, 30)]),
    (("UserInfo{0:I:13}", "usagestats user", None), []),
    (('name: "Car"', "bluetooth_manager", None), [("bluetooth_name", "Car")]),
    (("IMEI: 490154203237519", "iphonesubinfo", None), [("imei", "490154203237519", "490154203237519", 2)]),
    (("{fused, 1.5,2.5±3m, x}", "location", None), [("gps_coordinate", "1.5,2.5±3m", "1.5,2.5", 2)]),
    (("Package [a.b] installerPackageName=c.d", "package", None), [("package_name", "a.b"), ("package_name", "c.d")]),
    ((None, None, None), []),
    (("", "wifi", None), []),
]


def test_detectors(spark):
    df = spark.createDataFrame([(i, *x) for i, (x, _) in enumerate(SCANS)], "i int, t string, s string, k string")
    got = dict(df.select("i", detect.scan(detect.Context(F.col("t"), F.col("s"), F.col("k")))).collect())
    for i, (given, want) in enumerate(SCANS):
        hits = [tuple(h) for h in got[i]]
        assert [h[: len(w)] for h, w in zip(hits, want, strict=True)] == want, given


def test_views(spark):
    text = "5% of u=vic%40corp.com dG86IGEuYkBjb3JwLmV4YW1wbGUuY29tIG5vdw=="
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(encodings.scan_views(F.col("t"))).alias("h")).select("h.*").collect()
    assert {(r.view, r.value, r.canonical) for r in rows} == {("url", "vic%40corp.com", "vic@corp.com"), ("base64", "dG86IGEuYkBjb3JwLmV4YW1wbGUuY29tIG5vdw==", "a.b@corp.example.com")}
    whole = spark.createDataFrame([(text,)], "t string").select(encodings.url_decoded(F.col("t"), whole=True)).first()[0]
    assert whole is None


def test_structural_keys(spark):
    rows = spark.createDataFrame([("a.SSID", "Home"), ("b.comment", "x@y.org"), ("bluetooth.address", "AA:BB:CC:DD:EE:FF")], "k string, v string")
    got = [r[0][0][:3] for r in rows.select(structural.value_hits(F.col("v"), F.col("k"))).collect()]
    assert got == [("ssid", "Home", "Home"), ("email", "x@y.org", "x@y.org"), ("mac_address", "AA:BB:CC:DD:EE:FF", "aa:bb:cc:dd:ee:ff")]


def test_seal_and_open(spark):
    rows = spark.createDataFrame([("x@y.org",), ("",), ("ü" * 200,)], "v string")
    sealed = rows.select("v", seal.seal(F.col("v"), KEY).alias("s")).collect()
    assert all(r.s == r.v if not r.v else re.fullmatch(seal.TOKEN, r.s) for r in sealed)
    text = spark.createDataFrame([(" ".join(r.s for r in sealed),)], "t string")
    assert text.select(seal.open_text(F.col("t"), KEY)).first()[0] == " ".join(r.v for r in sealed)
    with pytest.raises(Exception, match="does not open"):
        text.select(seal.open_text(F.col("t"), Key(b"\x01" * 32))).collect()


def test_time_shift(spark):
    def shift(text, s, mode="date"):
        return spark.createDataFrame([(text,)], "t string").select(timeshift.shift_text(F.col("t"), s, mode)).first()[0]

    assert shift("2024-02-28T23:59:59.5Z", 2) == "2024-02-29T00:00:01.5Z"
    assert shift("2024-02-28T23:59:59.5Z", 2, "wrap") == "2024-02-28T00:00:01.5Z"
    assert shift("06-01 23:00:00.123 1717240496 1717240496000", 3600) == "06-01 00:00:00.123 1717244096 1717244096000"
    assert shift("2024-01-01 10:00:00.123", 3600) == "2024-01-01 11:00:00.123"
    assert shift("2024-01-01 10:00:00.123", 3600, "wrap") == "2024-01-01 12:00:00.123"
    rng = random.Random(1)
    for _ in range(5):
        s = rng.randrange(1, 10**6)
        t = f"20{rng.randrange(10, 40)}-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 1{rng.randrange(9)}:00:00"
        assert shift(shift(t, s), -s) == t
    assert [timeshift.parse_duration(x) for x in ("90", "90s", "15m", "2h")] == [90, 90, 900, 7200]


def test_policy_precedence_and_errors():
    p = policy.effective(policy.Options(only="accounts", keep_location=True, entity=("location=drop", "email=keep")))
    assert (p.action("email"), p.action("gps_coordinate"), p.action("user_name"), p.action("imei")) == ("keep", "drop", "pseudo", "keep")
    assert policy.effective(policy.Options(generalize_carrier=True, drop_carrier=True)).action("carrier") == "drop"
    assert policy.effective(policy.Options(time_shift=5)).action("timestamp") == "shift"
    assert policy.parse_kinds("Phone, device") >= {"phone_number", "imei"}
    for bad in (lambda: policy.parse_kinds(" ,"), lambda: policy.parse_kinds("nope"), lambda: policy.parse_entity("email"), lambda: policy.parse_entity("email=eat"), lambda: policy.load_profile("x")):
        with pytest.raises(PolicyError):
            bad()
    assert "(outside --only)" in policy.describe(policy.Options(only="email"))


def test_argon2id_known_answer():
    assert argon2id(b"password", b"somesalt", memory=256).hex() == "9dfeb910e80bad0311fee20f9c0e2b12c17987b4cac90c2ef54d5b3021c68bfe"
