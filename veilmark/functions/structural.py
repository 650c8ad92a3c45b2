"""Kinds by the name of a key, and values of structured members."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kinds import HIGH
from . import detect
from .text import ascii_lower

# Last component of a key path, and the kind of its value.
KEY_KINDS = {
    "ssid": "ssid", "wifi_network_name": "ssid", "bssid": "bssid", "mac": "mac_address", "mac_address": "mac_address", "hwaddr": "mac_address",
    "hardware_address": "mac_address", "email": "email", "account_name": "email", "appleid": "email", "apple_id": "email", "imei": "imei",
    "imsi": "imsi", "subscriber_id": "imsi", "iccid": "iccid", "phone": "phone_number", "msisdn": "phone_number", "phone_number": "phone_number",
    "serial": "serial_number", "serialnumber": "serial_number", "serial_number": "serial_number", "udid": "udid", "ecid": "udid",
    "latitude": "gps_coordinate", "longitude": "gps_coordinate", "lat": "gps_coordinate", "lon": "gps_coordinate", "package": "package_name",
    "package_name": "package_name", "pkg": "package_name", "bundleid": "package_name", "bundle_id": "package_name", "organization": "organization_name",
    "organizationname": "organization_name", "username": "user_name", "user_name": "user_name", "owner_name": "user_name",
}
LOWERED = ("email", "mac_address", "bssid", "uuid", "container_uuid")


def kind_of_key(key_path: Column) -> Column:
    """Kind that a key's name tells, or null."""
    last = ascii_lower(F.regexp_replace(F.substring_index(key_path, ".", -1), r"\[\d*\]", ""))
    table = F.create_map(*(F.lit(x) for pair in KEY_KINDS.items() for x in pair))
    bluetooth = (last == "address") & ascii_lower(key_path).contains("bluetooth")
    return F.when(bluetooth, F.lit("mac_address")).otherwise(F.try_element_at(table, last))


def canonical_of(kind: Column, value: Column) -> Column:
    return F.when(kind.isin(*LOWERED), ascii_lower(value)).otherwise(value)


def value_hits(value: Column, key_path: Column) -> Column:
    """One sure hit where the key tells the kind, else those of a scan."""
    kind = kind_of_key(key_path)
    whole = F.struct(kind.alias("kind"), value.alias("value"), canonical_of(kind, value).alias("canonical"), F.lit(HIGH).alias("confidence"), F.lit(0).alias("start"), F.length(value).alias("end")).cast(detect.HIT)
    return F.when(kind.isNotNull() & (value != ""), F.array(whole)).otherwise(detect.scan(detect.Context(value, None, key_path)))
