"""Detectors: text, section and key path to an array of hits, without leaving the JVM.

A hit is struct<kind, value, canonical, confidence, start, end>; offsets are characters, end
exclusive. A guard that is cheap and true wherever the pattern can match keeps most texts from the
regular expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kinds import HIGH, LOW, MEDIUM
from .text import FLAGS, ascii_lower, let, spans

HIT = "struct<kind:string,value:string,canonical:string,confidence:int,start:int,end:int>"
HITS = f"array<{HIT}>"
# The patterns and ranges that results depend on.
# As in RE2: words are of ASCII, so letters of other scripts end an address; K and s have a form outside it. (\b differs between Java's versions.)
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
EMAIL = rf"(?-Uu)(?i){_EDGE}[a-z\u212a\u017f0-9._%+\-]+@[a-z\u212a\u017f0-9.\-]+\.[a-z\u212a\u017f]{{2,}}{_EDGE}"
IMEI = r"\b\d{15}\b"
MAC = r"(?i)\b(?:[0-9a-f]{2}:){5}[0-9a-f]{2}\b"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b"
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
GPS = r"(-?\d{1,3}\.\d{4,})\s*,\s*(-?\d{1,3}\.\d{4,})"
PHONE = r"\+\d[\d\-() ]{7,}\d"
PRIVATE_IPV4 = r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)"
PSEUDO_IPV4 = r"^(198\.51\.100|203\.0\.113)\."


def _none() -> Column:
    return F.array().cast(HITS)


def _hit(kind: Column | str, value: Column, canonical: Column, confidence: Column, start: Column, length: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    end = start + (F.length(value) if length is None else length)
    return F.struct(kind.alias("kind"), value.alias("value"), canonical.alias("canonical"), confidence.cast("int").alias("confidence"), start.cast("int").alias("start"), end.cast("int").alias("end")).cast(HIT)


class Context:
    """A chunk's columns; section and key_path may be null."""

    def __init__(self, text: Column, section: Column | None = None, key_path: Column | None = None, dense: bool = False):
        self.text, self.dense = text, dense  # dense: of many thousands of hits
        self.section = F.lit(None).cast("string") if section is None else section
        self.key_path = F.lit(None).cast("string") if key_path is None else key_path

    def within(self, *names: str) -> Column:
        """The section's name contains one of these."""
        return F.coalesce(self.section.rlike("|".join(names)), F.lit(False))

    def confidence(self, base: int) -> Column:
        return F.when(self.section.isNotNull() | self.key_path.isNotNull(), F.lit(HIGH)).otherwise(F.lit(base))


def _all(c: Context, guard: Column, pattern: str, keep: Callable[[Column], Column], hit: Callable[[Column], Column], groups: tuple[int, ...] = ()) -> Column:
    found = F.transform(F.filter(spans(c.text, FLAGS + pattern, groups, c.dense), keep), hit)
    return F.when(F.coalesce(guard, F.lit(False)), found).otherwise(_none())


def email(c: Context) -> Column:
    low = lambda x: F.lower(x["m"])
    return _all(c, c.text.contains("@"), EMAIL, lambda x: ~low(x).contains("@2x") & ~low(x).endswith(".invalid"), lambda x: _hit("email", x["m"], low(x), c.confidence(LOW), x["start"]))


def imei(c: Context) -> Column:
    high = F.when(c.within("telephony", "iphonesubinfo", "radio"), F.lit(HIGH)).otherwise(F.lit(LOW))
    return _all(c, c.text.rlike(r"\d{15}"), IMEI, lambda x: F.call_function("luhn_check", x["m"]), lambda x: _hit("imei", x["m"], x["m"], high, x["start"]))


def _real_mac(v: Column) -> Column:
    low = ascii_lower(v)
    return ~low.startswith("02:") & ~low.isin("00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff")


def mac(c: Context) -> Column:
    kind = F.when(c.within("wifi"), F.lit("bssid")).otherwise(F.lit("mac_address"))
    near = c.within("wifi", "bluetooth", "net")
    return _all(c, c.text.contains(":"), MAC, lambda x: _real_mac(x["m"]) & (near | x["m"].rlike("[a-fA-F]")), lambda x: _hit(kind, x["m"], ascii_lower(x["m"]), c.confidence(MEDIUM), x["start"]))


def private_ipv4(v: Column) -> Column:
    return v.rlike(PRIVATE_IPV4)


def ipv4(c: Context) -> Column:
    def version(x: Column) -> Column:
        """It is preceded, in its line, by what makes it a version number."""
        line = ascii_lower(F.substring_index(F.substring(c.text, F.lit(1), x["start"]), "\n", -1))
        return line.contains("version") | line.endswith("v") | line.endswith("v=")

    kind = lambda x: F.when(private_ipv4(x["m"]), F.lit("ipv4_private")).otherwise(F.lit("ipv4_public"))
    return _all(c, c.text.rlike(r"\d\.\d"), IPV4, lambda x: ~x["m"].rlike(PSEUDO_IPV4) & ~version(x), lambda x: _hit(kind(x), x["m"], x["m"], c.confidence(LOW), x["start"]))


def uuid(c: Context) -> Column:
    def kind(x: Column) -> Column:
        begin = F.greatest(x["start"] - 39, F.lit(1))
        before = ascii_lower(F.substring(c.text, begin, x["start"] + 1 - begin))
        return F.when(before.contains("containers"), F.lit("container_uuid")).otherwise(F.lit("uuid"))

    return _all(c, c.text.contains("-"), UUID, lambda x: F.lit(True), lambda x: _hit(kind(x), x["m"], ascii_lower(x["m"]), c.confidence(MEDIUM), x["start"]))


def plain_number(v: Column) -> Column:
    """A decimal number without needless zeros and without an exponent."""
    trimmed = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"^(-?)0+(?=\d)", "$1"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(trimmed == "-0", F.lit("-0")).otherwise(trimmed)


def gps(c: Context) -> Column:
    lat, lon = lambda x: x["g1"].try_cast("double"), lambda x: x["g2"].try_cast("double")
    level = F.when(c.within("location"), F.lit(HIGH)).otherwise(F.lit(MEDIUM))
    return _all(c, c.text.rlike(r"\.\d{4}"), GPS, lambda x: F.coalesce(lat(x).between(-90, 90) & lon(x).between(-180, 180), F.lit(False)), lambda x: _hit("gps_coordinate", x["m"], F.concat(plain_number(x["g1"]), F.lit(","), plain_number(x["g2"])), level, x["start"]), (1, 2))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]", "")


def phone(c: Context) -> Column:
    level = F.when(c.section.isNotNull(), F.lit(MEDIUM)).otherwise(F.lit(LOW))
    return _all(c, c.text.contains("+"), PHONE, lambda x: F.length(_digits(x["m"])).between(8, 15), lambda x: _hit("phone_number", x["m"], F.concat(F.lit("+"), _digits(x["m"])), level, x["start"]))


LEXICAL = {"email": email, "imei": imei, "mac": mac, "ipv4": ipv4, "uuid": uuid, "gps": gps, "phone": phone}


# ---- contextual: a pattern is (what precedes)(value); the hit is the value. The patterns below.


def _value(c: Context, guard: Column, pattern: str, kind: Callable[[Column], Column], keep: Callable[[Column], Column] = lambda v: F.lit(True), canonical: Callable[[Column], Column] = lambda v: v, trim: bool = False) -> Column:
    v = lambda x: F.regexp_replace(x["g2"], r"^\s+|\s+$", "") if trim else x["g2"]
    return _all(c, guard, pattern, lambda x: keep(v(x)), lambda x: _hit(kind(v(x)), v(x), canonical(v(x)), F.lit(HIGH), x["start"] + F.length(x["g1"])), (1, 2))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda v: F.lit(kind)


def ctx_account(c: Context) -> Column:
    return _value(c, c.within("account"), r"(Account \{name=)([^,]+), type=[^}]+\}", lambda v: F.when(v.contains("@"), F.lit("email")).otherwise(F.lit("user_name")), canonical=ascii_lower)


def ctx_user(c: Context) -> Column:
    here = c.within("user") & ~c.within("usagestats")
    known = lambda v: ~v.rlike(r"^User-[0-9a-f]{8}$")  # noqa: E731  already a pseudonym
    return F.concat(_value(c, here, r"(UserInfo\{\d+:)([^:]+):\d+\}", _is("user_name"), known), _value(c, here, r"(Owner name:\s*)(.+)", _is("user_name"), lambda v: known(v) & (v != ""), trim=True))


def ctx_wifi(c: Context) -> Column:
    here = c.within("wifi")
    ssid = _value(c, here, r'(?i)(SSID:\s*")([^"]+)"', _is("ssid"), lambda v: ~v.startswith("SSID-"))
    bssid = _value(c, here, rf"(?i)(BSSID:\s*)((?:[0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}})", _is("bssid"), _real_mac, ascii_lower)
    return F.concat(ssid, bssid)


def ctx_location(c: Context) -> Column:
    p = r"\{[^,]+,\s*(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)(±[^,]*)?"
    pair = lambda x: F.concat(x["g1"], F.lit(","), x["g2"])
    return _all(c, c.within("location"), p, lambda x: F.lit(True), lambda x: _hit("gps_coordinate", F.concat(pair(x), F.coalesce(x["g3"], F.lit(""))), pair(x), F.lit(HIGH), x["start"], F.length(x["m"])), (1, 2, 3))


def ctx_bluetooth(c: Context) -> Column:
    return _value(c, c.within("bluetooth"), r'(?i)(name:\s*")([^"]+)"', _is("bluetooth_name"), lambda v: ~v.startswith("BT-Device-"))


def ctx_telephony(c: Context) -> Column:
    return _value(c, c.within("telephony", "iphonesubinfo"), r"(?i)(IMEI[:\s]+)(\d{15})", _is("imei"))


def ctx_package(c: Context) -> Column:
    here = c.within("package")
    return F.concat(_value(c, here, r"(Package \[)([a-zA-Z0-9_./]+)\]", _is("package_name")), _value(c, here, r"(?i)((?:installer|initiating|originating)PackageName=)([a-zA-Z0-9_.]+)", _is("package_name")))


CONTEXTUAL = {"account": ctx_account, "user": ctx_user, "wifi": ctx_wifi, "location": ctx_location, "bluetooth": ctx_bluetooth, "telephony": ctx_telephony, "package": ctx_package}


def register(name: str, detector: Callable[[Context], Column], contextual: bool = False) -> None:
    """A detector of one's own: a function of a Context to an array of hits (HITS). It takes part in every scan from now on."""
    (CONTEXTUAL if contextual else LEXICAL)[name] = detector


def scan(c: Context, lexical: tuple[str, ...] | None = None, contextual: tuple[str, ...] | None = None) -> Column:
    """Hits of all detectors (or of those named), ordered by start, kind and canonical; of equal ones the surest."""
    lexical, contextual = (tuple(known) if names is None else names for names, known in ((lexical, LEXICAL), (contextual, CONTEXTUAL)))
    parts = [CONTEXTUAL[n](c) for n in contextual] + [LEXICAL[n](c) for n in lexical]
    hits = F.concat(*parts) if len(parts) > 1 else parts[0]
    less = lambda a, b, *rest: F.when(a < b, -1).when(a > b, 1).otherwise(rest[0] if rest else 0)
    ordered = F.array_sort(hits, lambda a, b: less(a["start"], b["start"], less(a["kind"], b["kind"], less(a["canonical"], b["canonical"], less(b["confidence"], a["confidence"])))))

    same = lambda a, b: (a["start"] == b["start"]) & (a["kind"] == b["kind"]) & (a["canonical"] == b["canonical"])
    return let(ordered, lambda rows: F.when(F.size(rows) < 2, rows).otherwise(F.filter(rows, lambda x, i: (i == 0) | ~same(F.get(rows, i - 1), x))))


def residual(c: Context) -> Column:
    """What a scan without context finds with Medium confidence or more."""
    return F.filter(scan(Context(c.text, dense=c.dense), contextual=("account",)), lambda h: h["confidence"] >= MEDIUM)


def crude_email_tokens(text: Column) -> Column:
    """Words with an @ and a dot, trimmed of surrounding marks."""
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(tokens, lambda t: t.contains("@") & t.contains(".") & ~t.endswith(".invalid"))
