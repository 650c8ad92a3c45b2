"""Pseudonym of each kind as a function of the original and its tag (64 hex digits).

Every generator takes (value, tag) columns and keeps what its kind's readers rely on: digits where
digits were, a Luhn check digit, lengths, separators, suffixes that no real name has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product names that stay visible, in the order they are looked for.
PRODUCTS = ("AirPods", "AirPods Pro", "AirPods Max", "Galaxy Buds", "Tesla Model 3", "Tesla Model Y", "Apple Watch", "Beats")
_L = F.lit


def _cut(c: Column, start: int, end: int) -> Column:
    return F.substring(c, start + 1, end - start)


def decimals(tag: Column) -> Column:
    """The tag with each hex digit taken modulo ten."""
    return F.translate(tag, "abcdef", "012345")


def _number(tag: Column, start: int, end: int) -> Column:
    return F.conv(_cut(tag, start, end), 16, 10)


def domain(value: Column, tag: Column) -> Column:
    host = F.concat(_L("host-"), _cut(tag, 0, 8))
    corp = F.concat(_L("corp-"), _cut(tag, 16, 20), _L(".invalid"))
    labels = F.size(F.split(value, r"\."))
    made = F.when(labels <= 1, F.concat(host, _L(".invalid"))).when(labels == 2, corp).otherwise(F.concat(host, _L("."), corp))
    return F.when(value.endswith(".invalid"), value).otherwise(made)


def domain_name(value: Column, tag: Column) -> Column:
    return F.when(value.rlike(r"^(host-|corp-).*\.invalid$"), value).otherwise(domain(value, tag))


def email(value: Column, tag: Column, domain_tag: Column | None = None) -> Column:
    """domain_tag: that of the domain, where equal domains shall stay equal."""
    at = F.substring(value, F.instr(value, "@") + 1, F.length(value))
    host = F.when(value.contains("@"), domain(at, tag if domain_tag is None else domain_tag)).otherwise(F.concat(_L("corp-"), _cut(tag, 0, 4), _L(".invalid")))
    done = value.rlike(r"^user-[^@]*@(example|corp-[^@]*)\.invalid$")
    return F.when(done, value).otherwise(F.concat(_L("user-"), _cut(tag, 0, 8), _L("@"), host))


def phone_number(value: Column, tag: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    code = F.when(n > 10, F.substring(digits, _L(1), F.least(F.greatest(n - 10, _L(1)), _L(3)))).otherwise(_L("1"))
    code = F.when(value.startswith("+"), code).otherwise(_L(""))
    need = F.greatest(n - F.length(code), _L(0))
    body = F.rpad(F.substring(F.concat(_L("555"), F.substring(decimals(tag), 2, 63)), _L(1), need), need, "0")
    made = F.concat(F.when(value.startswith("+"), _L("+")).otherwise(_L("")), code, body)
    return F.when(n == 0, F.concat(_L("+15550"), _cut(tag, 0, 7))).otherwise(made)


def imei(value: Column, tag: Column) -> Column:
    body = _cut(decimals(tag), 0, 14)
    tries = F.filter(F.transform(F.array(*(_L(str(d)) for d in range(10))), lambda d: F.concat(body, d)), lambda x: F.call_function("luhn_check", x))
    return F.try_element_at(tries, _L(1))


def digits_like(value: Column, tag: Column) -> Column:
    n = F.greatest(F.length(F.regexp_replace(value, "[^0-9]", "")), _L(1))
    return F.substring(F.repeat(decimals(tag), F.ceil(n / 64).cast("int")), _L(1), n)


def mac(value: Column, tag: Column) -> Column:
    return F.concat(_L("02:"), F.regexp_replace(_cut(tag, 0, 10), "(..)(?!$)", "$1:"))


def ssid(value: Column, tag: Column) -> Column:
    base, size = F.concat(_L("SSID-"), _cut(tag, 0, 4)), F.octet_length(value)
    return F.when(value.startswith("SSID-"), value).otherwise(F.rpad(F.substring(base, _L(1), F.greatest(size, _L(7))), F.greatest(size, _L(7)), "X"))


def uuid(value: Column, tag: Column) -> Column:
    version = F.when(F.substring(value, 15, 1).rlike("[1-5]"), F.substring(value, 15, 1)).otherwise(_L("4"))
    return F.concat(_cut(tag, 0, 8), _L("-"), _cut(tag, 8, 12), _L("-"), version, _cut(tag, 13, 16), _L("-"), _cut(tag, 16, 20), _L("-"), _cut(tag, 20, 32))


def udid(value: Column, tag: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]{40}$"), _cut(tag, 0, 40)).otherwise(_cut(F.concat(tag, tag), 0, 40))


def ipv4_public(value: Column, tag: Column) -> Column:
    net = F.when(F.pmod(_number(tag, 0, 2).cast("int"), _L(2)) == 0, _L("198.51.100.")).otherwise(_L("203.0.113."))
    return F.concat(net, _number(tag, 2, 4))


def ipv6(value: Column, tag: Column) -> Column:
    part = lambda a: F.coalesce(F.nullif(F.ltrim(_cut(tag, a, a + 4), _L("0")), _L("")), _L("0"))
    return F.concat(_L("2001:db8::"), part(0), _L(":"), part(4))


def serial_number(value: Column, tag: Column) -> Column:
    """Digits stay digits, letters letters of their case, other marks stay; one tag digit for each."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        h = F.substring(tag, F.pmod(acc["k"], _L(64)) + 1, _L(1))
        nibble = F.conv(h, 16, 10).cast("int")
        new = F.when(c.rlike("[0-9]"), F.pmod(nibble, _L(10)).cast("string")).when(c.rlike("[A-Z]"), F.char(nibble + 65)).when(c.rlike("[a-z]"), F.char(nibble + 97)).otherwise(c)
        return F.struct((acc["k"] + F.when(c.rlike("[0-9A-Za-z]"), 1).otherwise(0)).alias("k"), F.concat(acc["out"], new).alias("out"))

    return F.aggregate(chars, F.struct(_L(0).alias("k"), _L("").alias("out")), step, lambda acc: acc["out"])


def prefixed(prefix: str) -> Callable[[Column, Column], Column]:
    return lambda value, tag: F.concat(_L(prefix), _cut(tag, 0, 8))


def bluetooth_name(value: Column, tag: Column) -> Column:
    hint = F.coalesce(*(F.when(value.contains(p), _L(f" ({p})")) for p in PRODUCTS), _L(""))
    return F.when(value.startswith("BT-Device-"), value).otherwise(F.concat(_L("BT-Device-"), _cut(tag, 0, 4), hint))


def file_path_leaf(value: Column, tag: Column) -> Column:
    return F.concat(_L("file-"), _cut(tag, 0, 8), F.regexp_extract(value, r"^.+(\.[^.]+)$", 1))


def url(value: Column, tag: Column) -> Column:
    scheme = F.when(value.contains("://"), F.substring_index(value, "://", 1)).otherwise(_L("https"))
    rest = F.when(value.contains("://"), F.substring(value, F.instr(value, "://") + 3, F.length(value))).otherwise(value)
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "@", -1), ":", 1)
    return F.concat(scheme, _L("://"), domain_name(host, tag), _L("/"))


def generalized_carrier(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    code = value.rlike(r"^[0-9\- ]+$") & F.length(digits).isin(5, 6)
    return F.when(code, F.concat(_L("mcc-"), F.substring(digits, 1, 3))).otherwise(_L("carrier"))


def _same(value: Column, tag: Column) -> Column:
    return value


GENERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "email": email, "phone_number": phone_number, "imei": imei, "imsi": digits_like, "iccid": digits_like, "serial_number": serial_number, "udid": udid,
    "android_id": uuid, "mac_address": mac, "bssid": mac, "ssid": ssid, "bluetooth_name": bluetooth_name, "ipv4_public": ipv4_public, "ipv4_private": _same,
    "ipv6": ipv6, "domain_name": domain_name, "url": url, "uuid": uuid, "container_uuid": uuid, "person_name": prefixed("User-"), "user_name": prefixed("User-"),
    "organization_name": prefixed("Org-"), "gps_coordinate": lambda v, t: _L("<redacted>"), "cell_id": lambda v, t: _L("0"), "file_path_leaf": file_path_leaf,
    "package_name": prefixed("com.anon.pkg"), "timestamp": _same, "carrier": _same,
}


def pseudonym(kind: Column, value: Column, tag: Column, kinds: tuple[str, ...] = tuple(GENERATORS)) -> Column:
    """By kind; other kinds stay as they are. kinds: those that can occur, for a smaller expression."""
    by = F.lit(None).cast("string")
    for k in kinds:
        by = F.when(kind == k, GENERATORS[k](value, tag)).otherwise(by)
    return F.coalesce(by, value)


def wider(kind: Column, value: Column, tag: Column) -> Column:
    """As pseudonym, from larger ranges for kinds that have few: 240.0.0.0/4, which is reserved and not routed, longer names and numbers."""
    octets = F.concat_ws(".", (F.pmod(_number(tag, 0, 2).cast("int"), _L(15)) + 240).cast("string"), *(_number(tag, i, i + 2) for i in (2, 4, 6)))
    hint = F.coalesce(*(F.when(value.contains(p), _L(f" ({p})")) for p in PRODUCTS), _L(""))
    code = F.when(value.startswith("+"), _L("+1")).otherwise(_L(""))
    long = {"ipv4_public": octets, "ssid": F.concat(_L("SSID-"), _cut(tag, 0, 16)), "bluetooth_name": F.concat(_L("BT-Device-"), _cut(tag, 0, 16), hint), "phone_number": F.concat(code, _L("555"), _cut(decimals(tag), 0, 11))}
    out = pseudonym(kind, value, tag, tuple(k for k in GENERATORS if k not in long))
    for k, made in long.items():
        out = F.when(kind == k, made).otherwise(out)
    return out


def is_pseudonym(kind: Column, value: Column) -> Column:
    """The value has the shape that the kind's generator makes."""
    shapes = {
        "email": r"@.*\.invalid$", "domain_name": r"\.invalid$", "mac_address": r"^02:", "bssid": r"^02:", "ssid": r"^SSID-", "bluetooth_name": r"^BT-Device-",
        "ipv4_public": r"^(198\.51\.100|203\.0\.113)\.", "user_name": r"^User-", "person_name": r"^User-", "organization_name": r"^Org-",
        "package_name": r"^com\.anon\.pkg", "file_path_leaf": r"^file-", "gps_coordinate": r"^<redacted>$",
    }
    return F.coalesce(*(F.when(kind == k, value.rlike(p)) for k, p in shapes.items()), F.lit(False))


#: shapes that the residual gate lets pass whatever kind they were found as
GATE_SHAPES = ("email", "mac_address", "ssid", "domain_name", "ipv4_public", "user_name", "package_name")


def has_known_shape(value: Column) -> Column:
    out = F.lit(False)
    for k in GATE_SHAPES:
        out |= is_pseudonym(F.lit(k), value)
    return out


def dropped(kind: Column, value: Column, tag: Column) -> Column:
    """What action drop leaves: null for coordinates (they are rewritten by pattern)."""
    return F.when(kind == "gps_coordinate", F.lit(None).cast("string")).when(kind == "cell_id", _L("0")).when(kind == "url", url(value, tag)).otherwise(_L(""))
