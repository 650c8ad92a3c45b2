"""Queries of the engine's own operators over the given tables, and SQL with the same rows.

Identifiers that the tables lack stand in a dump text derived from customer; it is built by the
same concatenation in Spark and in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .functions import detect, encodings, pseudonym, seal, structural, timeshift
from .functions.keys import Key
from .operators import audit, entities, mapping, members, residual, rewrite
from .plans.policy import Options, Profile, effective
from .plans.storage import written
from .sources import archives as containers
from .sources import sections

KEY = Key(b"\x07" * 32)
Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        n = name or f.__name__
        _Q[n] = f
        if sql:
            _SQL[n] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import queries_runs  # noqa: F401  adds its own

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_MD5 = "md5(cast(c_custkey as string))"
DUMP = f"""concat('DUMP OF SERVICE account:', chr(10), 'Account {{name=', lower(replace(c_name, '#', '.')), '@corp', cast(c_nationkey as string), '.example.com, type=com.google}}', chr(10),
 'DUMP OF SERVICE user:', chr(10), 'UserInfo{{0:', c_name, ':13}}', chr(10), 'Owner name: ', c_name, chr(10),
 'DUMP OF SERVICE wifi:', chr(10), 'SSID: "Net ', c_mktsegment, '"', chr(10), 'BSSID: ', {", ':', ".join(f"substr({_MD5}, {i}, 2)" for i in (1, 3, 5, 7, 9, 11))}, chr(10),
 'DUMP OF SERVICE bluetooth_manager:', chr(10), 'name: "', c_name, ' AirPods"', chr(10), 'address: ', {", ':', ".join(f"substr({_MD5}, {i}, 2)" for i in (13, 15, 17, 19, 21, 23))}, chr(10),
 'DUMP OF SERVICE location:', chr(10), '{{fused, ', cast(c_custkey % 90 as string), '.', lpad(cast((c_custkey * 7919) % 1000000 as string), 6, '0'), ',-', cast(c_custkey % 180 as string), '.', lpad(cast((c_custkey * 104729) % 1000000 as string), 6, '0'), '±7.5m, Bundle}}', chr(10),
 'DUMP OF SERVICE iphonesubinfo:', chr(10), 'IMEI: 49015420', lpad(cast(c_custkey % 10000000 as string), 7, '0'), chr(10),
 'DUMP OF SERVICE package:', chr(10), 'Package [com.vendor', cast(c_nationkey as string), '.app]', chr(10), 'installerPackageName=com.android.vending', chr(10),
 'SYSTEM LOG:', chr(10), '06-01 12:00:', lpad(cast(c_custkey % 60 as string), 2, '0'), '.000 E http: user=', lower(replace(c_name, '#', '.')), '%40corp', cast(c_nationkey as string), '.example.com at 1717', lpad(cast(c_custkey % 1000000 as string), 6, '0'), ' uuid=',
 substr({_MD5}, 1, 8), '-', substr({_MD5}, 9, 4), '-4', substr({_MD5}, 14, 3), '-a', substr({_MD5}, 18, 3), '-', substr({_MD5}, 21, 12), chr(10))"""


def dumps(spark: SparkSession, d: str) -> DataFrame:
    """(id, text): a dump for each customer."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(DUMP).alias("text"))


def dump_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.explode_sections(dumps(spark, d))


# SQL of the same: dumps, their sections, HMAC tags
_D = f"d as (select c_custkey as id, {DUMP} as text from customer)"
_S = _D + """, s as (select id, i - 1 as chunk_no, regexp_extract(p, '^([^:]+):', 1) as section, 'DUMP OF SERVICE ' || p as text from
  (select id, unnest(string_split(text, 'DUMP OF SERVICE ')[2:]) as p, unnest(range(1, len(string_split(text, 'DUMP OF SERVICE ')))) as i from d))"""
_IN, _OUT = KEY.pads


def _tag(kind: str, value: str) -> str:
    return f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({kind} || '|' || {value}))))"


def _hits(hits: Column, *keep: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.kind", "h.value", "h.canonical", "h.confidence")



def _plain() -> detect.Context:
    return detect.Context(F.col("text"))


def _sectioned() -> detect.Context:
    return detect.Context(F.col("text"), F.col("section"))


# ---- detectors over documents

_EMAILS = r"""select doc_id, 'email' as kind, v as value, lower(v) as canonical, 0 as confidence from
 (select doc_id, unnest(regexp_extract_all(text, '(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b')) as v from documents) where not contains(lower(v), '@2x') and not ends_with(lower(v), '.invalid')"""


@query(_EMAILS)
def detect_email(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.email(_plain()), "doc_id")(table(spark, d, "documents"))


@query(r"""select doc_id, 'phone_number' as kind, v as value, '+' || regexp_replace(v, '[^0-9]', '', 'g') as canonical, 0 as confidence from
 (select doc_id, unnest(regexp_extract_all(text, '\+\d[\d\-() ]{7,}\d')) as v from documents) where length(regexp_replace(v, '[^0-9]', '', 'g')) between 8 and 15""")
def detect_phone(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.phone(_plain()), "doc_id")(table(spark, d, "documents"))


_O = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_IPS = rf"""(select doc_id, v from (select doc_id, unnest(regexp_extract_all(text, '\b(?:{_O}\.){{3}}{_O}\b')) as v from documents) where not starts_with(v, '198.51.100.') and not starts_with(v, '203.0.113.'))"""
_PRIVATE = r"regexp_matches(v, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.)')"


@query(f"select doc_id, case when {_PRIVATE} then 'ipv4_private' else 'ipv4_public' end as kind, v as value, v as canonical, 0 as confidence from {_IPS}")
def detect_ipv4(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.ipv4(_plain()), "doc_id")(table(spark, d, "documents"))


@query(f"select case when {_PRIVATE} then 'private' else 'public' end as scope, count(*) as n from {_IPS} group by 1")
def detect_ipv4_scope(spark: SparkSession, d: str) -> DataFrame:
    hits = detect_ipv4(spark, d)
    return hits.groupBy(F.when(F.col("kind") == "ipv4_private", F.lit("private")).otherwise(F.lit("public")).alias("scope")).agg(F.count("*").alias("n"))


@query(f"select conv_id, turn, count(*) as n_emails from (select conv_id, turn, unnest(regexp_extract_all(text || ' by c' || conv_id || '.' || role || '@mail.example.com', '(?i)\\b[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}\\b')) as v from conversations) group by all")
def detect_email_conversations(spark: SparkSession, d: str) -> DataFrame:
    signed = F.concat(F.col("text"), F.lit(" by c"), F.col("conv_id").cast("string"), F.lit("."), F.col("role"), F.lit("@mail.example.com"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.explode(detect.email(detect.Context(signed))).alias("h"))
    return rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n_emails"))


@query(r"""select doc_id, t as token from (select doc_id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+$', '') as t from documents)
 where contains(t, '@') and contains(t, '.') and not ends_with(t, '.invalid')""")
def crude_email_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(detect.crude_email_tokens(F.col("text"))).alias("token"))


# ---- detectors over the derived dumps

_LUHN = "list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 0 then (v[i]::int * 2) // 10 + (v[i]::int * 2) % 10 else v[i]::int end)) % 10 = 0"


@query(rf"with {_S} select id, 'imei' as kind, v as value, v as canonical, 2 as confidence from (select id, section, unnest(regexp_extract_all(text, '\b\d{{15}}\b')) as v from s where section = 'iphonesubinfo') where {_LUHN}")
def detect_imei_luhn(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.imei(_sectioned()), "id")(dump_sections(spark, d))


@query(rf"""with {_S} select id, case when section = 'wifi' then 'bssid' else 'mac_address' end as kind, v as value, lower(v) as canonical, 2 as confidence
 from (select id, section, unnest(regexp_extract_all(text, '(?i)\b(?:[0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}\b')) as v from s) where not starts_with(v, '02:') and v not in ('00:00:00:00:00:00', 'ff:ff:ff:ff:ff:ff')""")
def detect_mac(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.mac(_sectioned()), "id")(dump_sections(spark, d))


@query(rf"with {_D} select id, 'uuid' as kind, v as value, lower(v) as canonical, 1 as confidence from (select id, unnest(regexp_extract_all(text, '(?i)\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\b')) as v from d)")
def detect_uuid(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.uuid(_plain()), "id")(dumps(spark, d))


_TRIM = r"regexp_replace(regexp_replace({}, '(\.\d*?)0+$', '\1'), '\.$', '')"


@query(rf"""with {_S} select id, 'gps_coordinate' as kind, v as value, {_TRIM.format("split_part(v, ',', 1)")} || ',' || {_TRIM.format("split_part(v, ',', 2)")} as canonical, 2 as confidence
 from (select id, unnest(regexp_extract_all(text, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}')) as v from s where section = 'location') where abs(split_part(v, ',', 1)::double) <= 90 and abs(split_part(v, ',', 2)::double) <= 180""")
def detect_gps(spark: SparkSession, d: str) -> DataFrame:
    return _hits(detect.gps(_sectioned()), "id")(dump_sections(spark, d))


@query(rf"""with {_S} select id, count(*) as n, min(v) as first_canonical from (select id, unnest(regexp_extract_all(lower(url_decode(text)), '\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}\b')) as v from s where section = 'package') group by id""")
def detect_urlencoded(spark: SparkSession, d: str) -> DataFrame:
    hits = F.filter(encodings.url_hits(F.col("text"), F.col("section")), lambda h: h["kind"] == "email")
    rows = dump_sections(spark, d).where("section = 'package'").select("id", F.explode(hits).alias("h"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min("h.canonical").alias("first_canonical"))


_MAIL = "concat('note to ', lower(replace(c_name, '#', '.')), '@corp', cast(c_nationkey as string), '.example.com')"


@query(f"select c_custkey as id, 'email' as kind, to_base64(encode({_MAIL})) as value, lower(replace(c_name, '#', '.')) || '@corp' || c_nationkey || '.example.com' as canonical from customer")
def detect_base64(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("blob "), F.regexp_replace(F.base64(F.expr(_MAIL).cast("binary")), r"[\r\n]", ""), F.lit(" end")).alias("text"))
    return rows.select("id", F.explode(encodings.base64_hits(F.col("text"))).alias("h")).select("id", "h.kind", "h.value", "h.canonical")


def _ctx_sql(section: str, pattern: str, kind: str, group: int = 1, where: str = "true", canonical: str = "v") -> str:
    return f"with {_S} select id, {kind} as kind, v as value, {canonical} as canonical, 2 as confidence from (select id, unnest(regexp_extract_all(text, '{pattern}', {group})) as v from s where contains(section, '{section}')) where {where}"


def _ctx(name: str, build: Callable[[detect.Context], Column], sql: str) -> None:
    query(sql, f"ctx_{name}")(lambda spark, d: _hits(build(_sectioned()), "id")(dump_sections(spark, d)))


_ctx("account", detect.ctx_account, _ctx_sql("account", r"Account \{name=([^,]+), type=[^}]+\}", "case when contains(v, '@') then 'email' else 'user_name' end", canonical="lower(v)"))
_ctx("user", detect.ctx_user, f"with {_S} select id, 'user_name' as kind, v as value, v as canonical, 2 as confidence from (select id, unnest(list_concat(regexp_extract_all(text, 'UserInfo\\{{\\d+:([^:]+):\\d+\\}}', 1), regexp_extract_all(text, 'Owner name:\\s*(.+)', 1))) as v from s where contains(section, 'user'))")
_ctx("wifi", detect.ctx_wifi, f"with {_S} select id, case when contains(v, ':') then 'bssid' else 'ssid' end as kind, v as value, v as canonical, 2 as confidence from (select id, unnest(list_concat(regexp_extract_all(text, 'SSID:\\s*\"([^\"]+)\"', 1), regexp_extract_all(text, 'BSSID:\\s*((?:[0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}})', 1))) as v from s where contains(section, 'wifi')) where not starts_with(v, '02:') and not starts_with(v, 'SSID-')")
_ctx("location", detect.ctx_location, f"""with {_S} select id, 'gps_coordinate' as kind, v as value, split_part(v, '±', 1) as canonical, 2 as confidence from (select id, unnest(regexp_extract_all(text, '\\{{[^,]+,\\s*(-?\\d+\\.\\d+\\s*,\\s*-?\\d+\\.\\d+(?:±[^,]*)?)', 1)) as v from s where contains(section, 'location'))""")
_ctx("bluetooth", detect.ctx_bluetooth, _ctx_sql("bluetooth", r'(?i)name:\s*"([^"]+)"', "'bluetooth_name'", where="not starts_with(v, 'BT-Device-')"))
_ctx("telephony", detect.ctx_telephony, _ctx_sql("iphonesubinfo", r"(?i)IMEI[:\s]+(\d{15})", "'imei'"))
_ctx("package", detect.ctx_package, f"with {_S} select id, 'package_name' as kind, v as value, v as canonical, 2 as confidence from (select id, unnest(list_concat(regexp_extract_all(text, 'Package \\[([a-zA-Z0-9_./]+)\\]', 1), regexp_extract_all(text, '(?:installer|initiating|originating)PackageName=([a-zA-Z0-9_.]+)', 1))) as v from s where contains(section, 'package'))")


def _dump_hits(spark: SparkSession, d: str) -> DataFrame:
    """Literal hits of all sections with their section."""
    return dump_sections(spark, d).select("id", "chunk_no", "section", F.explode(detect.scan(_sectioned())).alias("h")).select("id", "chunk_no", "section", "h.*")


_ALL_HITS = rf"""h as (
 select id, chunk_no, 'email' as kind, lower(v) as canonical, v as value from (select id, chunk_no, unnest(regexp_extract_all(text, '(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}\b')) as v from s)
 union all select id, chunk_no, 'user_name', v, v from (select id, chunk_no, unnest(list_concat(regexp_extract_all(text, 'UserInfo\{{\d+:([^:]+):\d+\}}', 1), regexp_extract_all(text, 'Owner name:\s*(.+)', 1))) as v from s where section = 'user')
 union all select id, chunk_no, case when section = 'wifi' then 'bssid' else 'mac_address' end, v, v from (select id, chunk_no, section, unnest(regexp_extract_all(text, '\b(?:[0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}\b')) as v from s) where not starts_with(v, '02:')
 union all select id, chunk_no, 'ssid', v, v from (select id, chunk_no, unnest(regexp_extract_all(text, 'SSID:\s*"([^"]+)"', 1)) as v from s where section = 'wifi')
 union all select id, chunk_no, 'bluetooth_name', v, v from (select id, chunk_no, unnest(regexp_extract_all(text, 'name:\s*"([^"]+)"', 1)) as v from s where section = 'bluetooth_manager')
 union all select id, chunk_no, 'gps_coordinate', split_part(v, '±', 1), v from (select id, chunk_no, unnest(regexp_extract_all(text, '\{{[^,]+,\s*(-?\d+\.\d+\s*,\s*-?\d+\.\d+(?:±[^,]*)?)', 1)) as v from s where section = 'location')
 union all select id, chunk_no, 'gps_coordinate', {_TRIM.format("split_part(v, ',', 1)")} || ',' || {_TRIM.format("split_part(v, ',', 2)")}, v from (select id, chunk_no, unnest(regexp_extract_all(text, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}')) as v from s where section = 'location')
 union all select id, chunk_no, 'imei', v, v from (select id, chunk_no, unnest(regexp_extract_all(text, 'IMEI[:\s]+(\d{{15}})', 1)) as v from s where section = 'iphonesubinfo')
 union all select id, chunk_no, 'package_name', v, v from (select id, chunk_no, unnest(list_concat(regexp_extract_all(text, 'Package \[([a-zA-Z0-9_./]+)\]', 1), regexp_extract_all(text, 'PackageName=([a-zA-Z0-9_.]+)', 1))) as v from s where section = 'package')
 union all select id, chunk_no, 'uuid', v, v from (select id, chunk_no, unnest(regexp_extract_all(text, '\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\b')) as v from s))"""


@query(f"with {_S}, {_ALL_HITS} select id, chunk_no::int as chunk_no, kind, canonical, value from h")
def detect_all_hits(spark: SparkSession, d: str) -> DataFrame:
    return _dump_hits(spark, d).select("id", "chunk_no", "kind", "canonical", "value")


@query("select p_partkey as id, k as kind from (select p_partkey, unnest(['ssid', 'mac_address', 'email', null, 'phone_number', 'gps_coordinate', 'package_name']) as k from part) where k is not null")
def structural_kinds(spark: SparkSession, d: str) -> DataFrame:
    paths = ("net.SSID", "bluetooth.devices[2].address", "accounts.AppleID[0]", "net.address", "sim[1].msisdn", "pos.Latitude", "apps[3].bundle_id")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(*(F.lit(p) for p in paths))).alias("path"))
    return rows.select("id", structural.kind_of_key(F.col("path")).alias("kind")).where("kind is not null")


@query("""select c_custkey as id, f as key_path, 'user_name' as kind, c_name as canonical from customer, (select 'owner_name' as f) union all
 select c_custkey, 'email', 'email', lower(replace(c_name, '#', '.')) || '@Corp.example.com'.lower() from customer""")
def structural_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.array(F.struct(F.lit("owner_name").alias("k"), F.col("c_name").alias("v")), F.struct(F.lit("email").alias("k"), F.concat(F.replace("c_name", F.lit("#"), F.lit(".")), F.lit("@Corp.example.com")).alias("v")), F.struct(F.lit("comment").alias("k"), F.lit("nothing here").alias("v")))).alias("x"))
    return rows.select("id", F.col("x.k").alias("key_path"), F.explode(structural.value_hits(F.col("x.v"), F.col("x.k"))).alias("h")).select("id", "key_path", "h.kind", "h.canonical")


# ---- sections, members


@query(f"with {_S} select id, chunk_no::int as chunk_no, section, length(text)::int as n from s")
def sections_split(spark: SparkSession, d: str) -> DataFrame:
    return dump_sections(spark, d).select("id", "chunk_no", "section", F.length("text").alias("n"))


@query(f"""with {_S}, n as (select *, len(text) - len(replace(text, chr(10), '')) as nl from s) select id, section, (1 + coalesce(sum(nl) over (partition by id order by chunk_no rows between unbounded preceding and 1 preceding), 0))::int as start_line from n""")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    return dump_sections(spark, d).select("id", "section", "start_line")


@query(f"with {_S} select id, replace(text, 'DUMP OF SERVICE wifi:', '') as body from s where section = 'wifi'")
def section_named(spark: SparkSession, d: str) -> DataFrame:
    return dumps(spark, d).select("id", F.concat(sections.section_named(F.col("text"), "wifi"), F.lit("\n")).alias("body"))


_PATHS = "['img/p' || page_id || '.PNG', 'logs/a/Safari' || page_id || '.db', 'x/KnowledgeC.db', 'system_logs.logarchive/a.tracev3', 'FS/data/app.txt', 'version.txt']"


@query(f"""select page_id, member, case when regexp_matches(lower(member), '\\.(png|jpe?g|gif|heic|webp|bmp)$') then 'image; always drop' when contains(member, 'system_logs.logarchive/') then 'logarchive: binary dropped'
 when contains(member, 'Safari') then 'browsing history' when contains(lower(member), 'knowledgec.db') then 'usage by the minute' end as reason from (select page_id, unnest({_PATHS}) as member from pages)""")
def member_drop_rules(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    paths = F.array(F.concat(F.lit("img/p"), i, F.lit(".PNG")), F.concat(F.lit("logs/a/Safari"), i, F.lit(".db")), *(F.lit(x) for x in ("x/KnowledgeC.db", "system_logs.logarchive/a.tracev3", "FS/data/app.txt", "version.txt")))
    rows = table(spark, d, "pages").select("page_id", F.explode(paths).alias("member"))
    return rows.select("page_id", "member", members.drop_reason(F.col("member"), effective(Options())).alias("reason"))


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(replace('sysdiagnose_' || page_id || '\logs//a' || page_id || '.txt/', '\', '/'), '/+', '/', 'g'), '^/|/$', '', 'g'), '^sysdiagnose[^/]*/', '') as member from pages")
def member_paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    return table(spark, d, "pages").select("page_id", containers.normal_path(F.concat(F.lit("sysdiagnose_"), i, F.lit("\\logs//a"), i, F.lit(".txt/"))).alias("member"))


@query("""select nation, member from (select c_nationkey as nation, case when c_custkey % 7 = 0 then 'dumpstate-' || c_custkey || '.txt' when c_custkey % 5 = 0 then 'bugreport-' || c_custkey || '.txt' else 'log' || c_custkey || '.txt' end as member,
 row_number() over (partition by c_nationkey order by case when c_custkey % 7 = 0 then 2 when c_custkey % 5 = 0 then 4 else 5 end, c_custkey desc) as n from customer where c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey > 100000) where n = 1""")
def dumpstate_pick(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("dumpstate-"), k, F.lit(".txt"))).when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("bugreport-"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("log"), k, F.lit(".txt")))
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), name.alias("member"), F.col("c_custkey").alias("n_bytes"))
    return containers.pick_dumpstate(rows, "nation").select("nation", "member")


@query("select n_nationkey as id, case n_nationkey % 3 when 0 then 'android' when 1 then 'apple' else 'auto' end as kind from nation")
def container_sniff(spark: SparkSession, d: str) -> DataFrame:
    head = F.when(F.col("n_nationkey") % 3 == 0, F.unhex(F.lit("504B030414000000"))).when(F.col("n_nationkey") % 3 == 1, F.unhex(F.lit("1F8B080000000000"))).otherwise(F.lit("plain text").cast("binary"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), containers.archive_kind(head).alias("kind"))


# ---- entities, policy

_ENTITY = """e as (select kind, canonical, count(*) as occurrences, string_agg(distinct value, '|' order by value) as surfaces from h group by kind, canonical)"""


@query(f"with {_S}, {_ALL_HITS}, {_ENTITY} select kind, canonical, occurrences, surfaces from e")
def entity_table(spark: SparkSession, d: str) -> DataFrame:
    rows = entities.roll_up(_dump_hits(spark, d), order=("id", "chunk_no", "start"))
    return rows.select("kind", "canonical", "occurrences", F.array_join(F.array_sort("surface_forms"), "|").alias("surfaces"))


@query(f"with {_S}, {_ALL_HITS} select kind, canonical, min(id) as first_id from h group by kind, canonical")
def entity_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = entities.roll_up(_dump_hits(spark, d), order=("id", "chunk_no", "start"))
    return rows.select("kind", "canonical", F.col("first_seen.id").alias("first_id"))


@query(f"select kind, canonical, replacement from (select kind, canonical, count(*) as n from ({_EMAILS}) group by all), lateral (select {_tag('kind', 'canonical')} as t), lateral (select 'user-' || substr(t, 1, 8) || '@host-' || substr(t, 1, 8) || '.corp-' || substr(t, 17, 4) || '.invalid' as replacement)")
def entity_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    found = entities.roll_up(detect_email(spark, d))
    return found.select("kind", "canonical", pseudonym.email(F.col("canonical"), KEY.tag(F.col("kind"), F.col("canonical"))).alias("replacement"))


_ALL_KEPT = "kind in ('ipv4_private', 'timestamp')"
#: what each kind's action has to be, told apart from the policies' own files
_ACTIONS = {
    "strict": f"case when {_ALL_KEPT} then 'keep' when kind in ('url', 'gps_coordinate', 'cell_id', 'carrier') then 'drop' else 'pseudo' end",
    "balanced": f"case when {_ALL_KEPT} or kind in ('package_name', 'carrier') then 'keep' when kind in ('gps_coordinate', 'cell_id') then 'drop' else 'pseudo' end",
    "research": f"case when {_ALL_KEPT} or kind in ('package_name', 'carrier', 'gps_coordinate', 'cell_id') then 'keep' else 'pseudo' end",
    "only network and package": "case when kind in ('mac_address', 'bssid', 'ssid', 'bluetooth_name', 'ipv4_public', 'ipv6', 'domain_name', 'url', 'package_name') then 'pseudo' else 'keep' end",
    "accounts, location, imei": "case when kind in ('email', 'user_name', 'person_name', 'organization_name', 'imei') then 'pseudo' when kind in ('gps_coordinate', 'cell_id') then 'drop' else 'keep' end",
}


def _policy_sql(actions: str) -> str:
    return f"with {_S}, {_ALL_HITS} select kind, action, count(*) as entities, sum(occurrences)::bigint as occurrences from (select kind, canonical, count(*) as occurrences, {_ACTIONS[actions]} as action from h group by kind, canonical) group by kind, action"


def _policy(name: str, options: Options, actions: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = entities.roll_up(_dump_hits(spark, d), order=("id", "chunk_no", "start"))
        return entities.resolve(rows, effective(options), options).groupBy("kind", "action").agg(F.count("*").alias("entities"), F.sum("occurrences").alias("occurrences"))

    query(_policy_sql(actions), name)(run)


for _p in ("strict", "balanced", "research"):
    _policy(f"policy_actions_{_p}", Options(profile=_p), _p)
_policy("policy_only_group", Options(only="network, package"), "only network and package")
_policy("policy_override", Options(only="accounts", entity=("location=drop", "imei=pseudo")), "accounts, location, imei")


@query(f"select canonical, case when {_PRIVATE.replace('v,', 'canonical,')} then 'ipv4_private' else 'ipv4_public' end as kind, 'keep' as action, ({_PRIVATE.replace('v,', 'canonical,')}) = false as low from (select distinct v as canonical from {_IPS})")
def policy_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Public addresses in plain text are kept by the balanced profile; private ones are kept anyway."""
    return entities.resolve(entities.roll_up(detect_ipv4(spark, d)), effective(Options())).select("kind", "canonical", "action", "low")


@query("select n_nationkey as id, case n_nationkey % 3 when 0 then true when 1 then false else true end as allowed from nation")
def allow_domain(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 3
    host = F.when(k == 0, F.lit("fonts.gstatic.com")).when(k == 1, F.concat(F.lit("notgoogle"), F.col("n_nationkey").cast("string"), F.lit(".com"))).otherwise(F.lit("google.com"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), entities.allowed_domain(host).alias("allowed"))


@query(f"with {_S}, {_ALL_HITS} select canonical, case when canonical = 'com.android.vending' then 'keep' else 'pseudo' end as action from h where kind = 'package_name' group by canonical")
def allow_package(spark: SparkSession, d: str) -> DataFrame:
    options = Options(pseudo_third_party_packages=True)
    rows = entities.resolve(entities.roll_up(_dump_hits(spark, d).where("kind = 'package_name'")), effective(options), options)
    return rows.select("canonical", "action")


# ---- keys and pseudonyms


@query(f"select c_custkey, {_tag(chr(39) + 'email' + chr(39), 'c_name')} as tag from customer")
def hmac_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", KEY.tag(F.lit("email"), F.col("c_name")).alias("tag"))


_H = "t"
_DEC = "translate(t, 'abcdef', '012345')"


def _hexval(a: int, b: int) -> str:
    """Value of hex digits a to b (from 1) of the tag."""
    return " + ".join(f"(instr('0123456789abcdef', t[{i}]) - 1) * {16 ** (b - i)}" for i in range(a, b + 1))


def _generator(name: str, value_spark: str, value_sql: str, out_sql: str, kind: str | None = None) -> None:
    kind = kind or name
    sql = f"select c_custkey as id, {out_sql} as pseudonym from (select c_custkey, v, {_tag(chr(39) + kind + chr(39), 'v')} as t from (select c_custkey, {value_sql} as v from customer))"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(value_spark).alias("v"))
        return rows.select("id", pseudonym.GENERATORS[kind](F.col("v"), KEY.tag(F.lit(kind), F.col("v"))).alias("pseudonym"))

    query(sql, f"pseudo_{name}")(run)


_K = "cast(c_custkey as string)"
_UUID_OUT = "t[1:8] || '-' || t[9:12] || '-4' || t[14:16] || '-' || t[17:20] || '-' || t[21:32]"
_UUID_IN = f"concat(substr({_MD5}, 1, 8), '-', substr({_MD5}, 9, 4), '-4', substr({_MD5}, 14, 3), '-a', substr({_MD5}, 18, 3), '-', substr({_MD5}, 21, 12))"
_LUHN_DIGIT = f"((10 - list_sum(list_transform(range(1, 15), lambda i: case when i % 2 = 0 then ({_DEC}[i]::int * 2) // 10 + ({_DEC}[i]::int * 2) % 10 else {_DEC}[i]::int end)) % 10) % 10)::int::varchar"
_G = {
    "email": (f"concat('u', {_K}, '@corp.example.com')", "'user-' || t[1:8] || '@host-' || t[1:8] || '.corp-' || t[17:20] || '.invalid'"),
    "domain_name": (f"concat('h', {_K}, '.com')", "'corp-' || t[17:20] || '.invalid'"),
    "phone_number": (f"concat('+4930', lpad({_K}, 8, '1'))", f"'+49' || ('555' || {_DEC}[2:])[1:10]"),
    "imei": (f"concat('49015420', lpad({_K}, 7, '0'))", f"{_DEC}[1:14] || {_LUHN_DIGIT}"),
    "imsi": (f"concat('26201', lpad({_K}, 10, '0'))", f"{_DEC}[1:15]"),
    "iccid": (f"concat('8949', lpad({_K}, 15, '0'))", f"{_DEC}[1:19]"),
    "mac_address": (_MD5, "'02:' || t[1:2] || ':' || t[3:4] || ':' || t[5:6] || ':' || t[7:8] || ':' || t[9:10]"),
    "bssid": (_MD5, "'02:' || t[1:2] || ':' || t[3:4] || ':' || t[5:6] || ':' || t[7:8] || ':' || t[9:10]"),
    "ssid": ("concat('Net ', c_mktsegment)", "rpad('SSID-' || t[1:4], length(v)::int, 'X')"),
    "bluetooth_name": ("concat(c_name, ' AirPods Pro')", "'BT-Device-' || t[1:4] || ' (AirPods)'"),
    "uuid": (_UUID_IN, _UUID_OUT),
    "container_uuid": (_UUID_IN, _UUID_OUT),
    "android_id": (f"substr({_MD5}, 1, 14)", _UUID_OUT),
    "udid": (f"concat({_MD5}, substr({_MD5}, 1, 8))", "t[1:40]"),
    "ipv4_public": (f"concat('8.8.', cast(c_nationkey as string), '.', {_K})", f"case when ({_hexval(1, 2)}) % 2 = 0 then '198.51.100.' else '203.0.113.' end || ({_hexval(3, 4)})::varchar"),
    "ipv6": (f"concat('2a00::', {_K})", "'2001:db8::' || coalesce(nullif(ltrim(t[1:4], '0'), ''), '0') || ':' || coalesce(nullif(ltrim(t[5:8], '0'), ''), '0')"),
    "user_name": ("c_name", "'User-' || t[1:8]"),
    "person_name": ("c_name", "'User-' || t[1:8]"),
    "organization_name": ("c_mktsegment", "'Org-' || t[1:8]"),
    "file_path_leaf": (f"concat('photo', {_K}, '.tar.gz')", "'file-' || t[1:8] || '.gz'"),
    "package_name": ("concat('com.vendor', cast(c_nationkey as string))", "'com.anon.pkg' || t[1:8]"),
    "url": (f"concat('https://me@h', {_K}, '.com:8443/p?q=1')", "'https://corp-' || t[17:20] || '.invalid/'"),
    "serial_number": (f"concat('A', lpad({_K}, 4, '0'), '-z')", "chr((64 + instr('0123456789abcdef', t[1]))::int) || translate(t[2:5], 'abcdef', '012345') || '-' || chr((96 + instr('0123456789abcdef', t[6]))::int)"),
    "gps_coordinate": (f"concat({_K}, '.1234,5.6789')", "'<redacted>'"),
    "cell_id": (_K, "'0'"),
    "carrier": ("c_mktsegment", "v"),
}
for _n, (_in, _out) in _G.items():
    _generator(_n, _in, _in, _out)


@query("select c_custkey as id, case when c_custkey % 2 = 0 then 'mcc-' || lpad((c_custkey % 1000)::varchar, 3, '0') else 'carrier' end as carrier from customer")
def generalize_carrier(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    value = F.when(k % 2 == 0, F.concat(F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-07"))).otherwise(F.col("c_mktsegment"))
    return table(spark, d, "customer").select(k.alias("id"), pseudonym.generalized_carrier(value).alias("carrier"))


@query("select kind, count(*) as n from (values ('email'), ('ssid'), ('user_name'), ('package_name')) x(kind), customer group by kind")
def pseudonym_shapes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_name", F.explode(F.array(*(F.lit(k) for k in ("email", "ssid", "user_name", "package_name")))).alias("kind"))
    made = rows.withColumn("p", pseudonym.pseudonym(F.col("kind"), F.col("c_name"), KEY.tag(F.col("kind"), F.col("c_name"))))
    return made.where(pseudonym.is_pseudonym(F.col("kind"), F.col("p"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""with {_S}, {_ALL_HITS}, e as (select kind, canonical, min(id) as first_id from h where kind in ('email', 'ssid', 'user_name') group by kind, canonical)
 select kind, canonical, case kind when 'email' then 'user-' || n || '@example.invalid' when 'ssid' then 'SSID-' || n else 'User-' || n end as name from (select *, row_number() over (partition by kind order by first_id, canonical) as n from e)""")
def ordinal_names(spark: SparkSession, d: str) -> DataFrame:
    rows = entities.roll_up(_dump_hits(spark, d), order=("id",))
    return mapping.ordinals(rows).where("ordinal_name is not null").select("kind", "canonical", F.col("ordinal_name").alias("name"))


@query("""select kind, canonical, candidate, (row_number() over (partition by candidate order by canonical) - 1)::int as collision from
 (select 'ipv4_public' as kind, '8.8.' || c_nationkey || '.' || c_custkey as canonical, '203.0.113.' || c_custkey % 256 as candidate from customer)""")
def collision_rank(spark: SparkSession, d: str) -> DataFrame:
    k, n = (F.col(c).cast("string") for c in ("c_custkey", "c_nationkey"))
    rows = table(spark, d, "customer").select(F.lit("ipv4_public").alias("kind"), F.concat(F.lit("8.8."), n, F.lit("."), k).alias("canonical"), F.concat(F.lit("203.0.113."), (F.col("c_custkey") % 256).cast("string")).alias("candidate"))
    return mapping.collisions(rows)


# ---- rewriting


@query(rf"""select doc_id, regexp_replace(text, '\b({_O}\.){{3}}{_O}\b', '203.0.113.1', 'g') as text from documents where regexp_matches(text, '\b({_O}\.){{3}}{_O}\b')""")
def rewrite_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Every address found is a surface; each is replaced by one literal."""
    hits = table(spark, d, "documents").select("doc_id", "text", F.explode(detect.ipv4(_plain())).alias("h"))
    pairs = rewrite.surface_pairs(hits.select("doc_id", F.col("h.value").alias("surface"), F.lit("203.0.113.1").alias("replacement")).distinct(), "doc_id")
    return table(spark, d, "documents").join(pairs, "doc_id").select("doc_id", rewrite.apply_surfaces(F.col("text"), F.col("pairs")).alias("text"))


@query()
def rewrite_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the strict profile's pseudonyms, one mapping for all."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    # more addresses than the two networks of documentation hold
    return engine.anonymize_table(docs, ["doc_id"], ["text"], key=KEY, options=Options(profile="strict", on_collision="widen")).rewritten


@query()
def rewrite_documents_by_row(spark: SparkSession, d: str) -> DataFrame:
    """The same without a shuffle, each row by its own hits."""
    return table(spark, d, "documents").select("doc_id", engine.pseudonymize_column(F.col("text"), KEY, Options(profile="strict")).alias("text"))


@query(rf"with {_D} select id, regexp_replace(text, '\{{([^,]+),\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+(±[^,}}]*)?', '{{\1, <redacted>\2', 'g') as text from d")
def gps_drop(spark: SparkSession, d: str) -> DataFrame:
    return dumps(spark, d).select("id", rewrite.drop_gps(F.col("text")).alias("text"))


@query(f"with {_D} select id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: case when contains(x, 'com.vendor1.app') or contains(x, 'com.android.vending') then '<log line dropped>' else x end), chr(10)) as text from d")
def drop_package_lines(spark: SparkSession, d: str) -> DataFrame:
    return dumps(spark, d).select("id", rewrite.drop_package_lines(F.col("text"), ("com.vendor1.app", "com.android.vending")).alias("text"))


@query("select c_custkey as id, 'at ' || (1700000000 + c_custkey + 3600) || ' and ' || ((1700000000 + c_custkey) * 1000 + 5 + 3600000) || ' not 123' as text from customer")
def time_shift_epoch(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("at "), (k + 1_700_000_000).cast("string"), F.lit(" and "), ((k + 1_700_000_000) * 1000 + 5).cast("string"), F.lit(" not 123"))
    return table(spark, d, "customer").select(k.alias("id"), timeshift.shift_text(text, 3600).alias("text"))


@query("select c_custkey as id, '06-01 ' || lpad(((c_custkey % 24 + 2) % 24)::varchar, 2, '0') || ':00:' || lpad((c_custkey % 60)::varchar, 2, '0') || '.123 E x' as text from customer")
def time_shift_logcat(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("06-01 "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(".123 E x"))
    return table(spark, d, "customer").select(k.alias("id"), timeshift.shift_text(text, 7200).alias("text"))


@query("select event_id, 'x ' || strftime(date_trunc('second', ts) + interval 90061 second, '%Y-%m-%dT%H:%M:%S') || 'Z y' as text from events")
def time_shift_iso(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("x "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z y"))
    return table(spark, d, "events").select("event_id", timeshift.shift_text(text, 90_061).alias("text"))


# ---- residual gate, audit


@query(rf"""with {_D} select kind, count(*) as n from (select 'mac_address' as kind, unnest(regexp_extract_all(text, '\b(?:[0-9a-f]{{2}}:){{5}}[0-9a-f]{{2}}\b')) as v from d
 union all select 'uuid', unnest(regexp_extract_all(text, '\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}\b')) from d
 union all select 'gps_coordinate', unnest(regexp_extract_all(text, '-?\d{{1,3}}\.\d{{4,}}\s*,\s*-?\d{{1,3}}\.\d{{4,}}')) from d) where not starts_with(v, '02:') and (kind != 'mac_address' or regexp_matches(v, '[a-f]')) group by kind""")
def residual_findings(spark: SparkSession, d: str) -> DataFrame:
    return dumps(spark, d).select(F.explode(residual.residual_hits(F.col("text"))).alias("h")).groupBy(F.col("h.kind").alias("kind")).agg(F.count("*").alias("n"))


@query("select id, case when id % 3 = 0 then 0 else 1 end::bigint as n_findings, case when id % 3 = 0 then 'clean' else 'failed' end as status from (select c_custkey as id from customer)")
def residual_status(spark: SparkSession, d: str) -> DataFrame:
    """Of three texts one has a pseudonym only, one a real address, one both."""
    m = F.col("c_custkey") % 3
    real, done = F.lit(" de:ad:be:ef:00:01 "), F.lit(" 02:ad:be:ef:00:01 ")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("m").alias("member"), F.lit("text").alias("handler"), F.when(m == 0, done).when(m == 1, real).otherwise(F.concat(done, real)).alias("text"))
    none = spark.createDataFrame([], "id bigint, kind string, canonical string, replacement string")
    return residual.status(residual.findings(rows, none, none, ("id",)), rows, False, ("id",))


@query(_policy_sql("balanced").replace("count(*) as entities, sum(occurrences)::bigint as occurrences", "sum(occurrences)::bigint as count"))
def audit_entity_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = entities.roll_up(_dump_hits(spark, d), order=("id", "chunk_no", "start"))
    return entities.summary(entities.resolve(rows, effective(Options())))


@query()
def audit_json(spark: SparkSession, d: str) -> DataFrame:
    """A report for each nation's customers, as one archive."""
    from .queries_runs import PER_TASK

    # a join to find the nations could broadcast the texts, since their size is guessed from the table's
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    texts = rows.repartition(rows.count() // PER_TASK + 1).select(F.col("c_nationkey").cast("string").alias("archive_id"), F.col("c_custkey").alias("id"), F.expr(DUMP).alias("text"))
    hits = sections.explode_sections(texts).select("archive_id", "id", "chunk_no", F.explode(detect.scan(_sectioned())).alias("h")).select("archive_id", "id", "chunk_no", "h.*")
    # four parts of the report read it
    found = written(entities.resolve(entities.roll_up(hits, ("archive_id",), ("id", "chunk_no", "start")), effective(Options())))
    sizes = found.select("archive_id").distinct().select("archive_id", F.lit("auto").alias("kind"), F.lit(0).cast("bigint").alias("n_bytes"), F.lit("").alias("out_sha256"), F.lit(0).alias("out_bytes"))
    nothing = spark.createDataFrame([], "archive_id string, kind string, member string, confidence string, snippet_len int")
    dropped = spark.createDataFrame([], "archive_id string, path string, bytes int, reason string")
    return audit.report(sizes, entities.summary(found, "archive_id"), dropped, entities.warnings(found, "archive_id"), nothing, residual.status(nothing, sizes, False), audit.divergences(found, Options()), Options()).select("archive_id", "profile", "report_json")


@query("select c_nationkey, count(distinct c_name) as n from customer group by c_nationkey")
def join_cardinality_preserved(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names by nation, counted on pseudonyms."""
    rows = table(spark, d, "customer").select("c_nationkey", F.col("c_name").alias("canonical"))
    names = rows.select(F.lit("user_name").alias("kind"), "canonical", F.lit("pseudo").alias("action")).where("canonical is not null").distinct()
    made = mapping.replacements(names, KEY).select("canonical", F.col("replacement").alias("p"))  # unique, as tags cut to 32 bits are not
    return rows.join(made, "canonical", "left").groupBy("c_nationkey").agg(F.count_distinct("p").alias("n"))


@query("select o_orderpriority, count(*) as n from orders join customer on o_custkey = c_custkey group by o_orderpriority")
def pseudonym_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders joined to customers by pseudonyms of the key on both sides."""
    def made(c: str) -> Column:
        v = F.col(c).cast("string")
        return KEY.tag(F.lit("user_name"), v)

    left = table(spark, d, "orders").select("o_orderpriority", made("o_custkey").alias("p"))
    right = table(spark, d, "customer").select(made("c_custkey").alias("p"))
    return left.join(right, "p").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# ---- seal and restore


@query()
def seal_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", seal.seal(F.col("c_name"), KEY).alias("token"))


@query("select c_custkey, 'a ' || c_name || ' b ' || c_mktsegment || ' c' as text, 2 as n_tokens from customer")
def restore_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    sealed = F.concat(F.lit("a "), seal.seal(F.col("c_name"), KEY), F.lit(" b "), seal.seal(F.col("c_mktsegment"), KEY), F.lit(" c"))
    rows = table(spark, d, "customer").select("c_custkey", sealed.alias("s"))
    return rows.select("c_custkey", seal.open_text(F.col("s"), KEY).alias("text"), seal.token_count(F.col("s")).alias("n_tokens"))


@query()
def streaming_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """The row-by-row rewrite as a stream over documents."""
    from .streaming.rewrite import rewrite_stream

    return rewrite_stream(spark, f"{d}/documents.parquet", "doc_id", "text", KEY, Options(profile="strict"))


def profile_actions(profile: Profile) -> dict[str, str]:
    return {k: profile.action(k) for k in pseudonym.GENERATORS}
