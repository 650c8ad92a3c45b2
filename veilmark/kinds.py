"""Entity kinds, their aliases and groups, actions and confidences."""

from __future__ import annotations

# Names, aliases, groups and profile actions that results depend on.
KINDS = (
    "email", "phone_number", "imei", "imsi", "iccid", "serial_number", "udid", "android_id", "mac_address", "bssid",
    "ssid", "bluetooth_name", "ipv4_public", "ipv4_private", "ipv6", "domain_name", "url", "uuid", "container_uuid",
    "person_name", "user_name", "organization_name", "gps_coordinate", "cell_id", "file_path_leaf", "package_name",
    "timestamp", "carrier",
)
ALIASES = {
    "apple_id": "email", "google_account": "email", "phone": "phone_number", "msisdn": "phone_number", "serial": "serial_number",
    "ecid": "udid", "gsf_id": "android_id", "advertising_id": "android_id", "mac": "mac_address", "bt_name": "bluetooth_name",
    "domain": "domain_name", "username": "user_name", "org": "organization_name", "gps": "gps_coordinate", "location": "gps_coordinate",
    "cid": "cell_id", "lac": "cell_id", "path_leaf": "file_path_leaf", "package": "package_name", "mcc_mnc": "carrier",
}
GROUPS = {
    "identifiers": ("email", "phone_number", "imei", "imsi", "iccid", "serial_number", "udid", "android_id", "user_name", "person_name", "organization_name"),
    "accounts": ("email", "user_name", "person_name", "organization_name"),
    "device": ("imei", "imsi", "iccid", "serial_number", "udid", "android_id"),
    "network": ("mac_address", "bssid", "ssid", "bluetooth_name", "ipv4_public", "ipv6", "domain_name", "url"),
    "location": ("gps_coordinate", "cell_id"),
    "all": KINDS,
}
ACTIONS = ("keep", "pseudo", "drop", "generalize", "shift")
CONFIDENCE = ("low", "medium", "high")
LOW, MEDIUM, HIGH = range(3)
ORDER = {k: i for i, k in enumerate(KINDS)}


class PolicyError(ValueError):
    """An unknown kind, action or profile."""


class ParseError(ValueError):
    """A member that cannot be read as what it claims to be."""


class UnsupportedArchive(ValueError):
    """Neither a zip nor a tar archive."""


class CryptoError(ValueError):
    """A sealed value that the key does not open."""


class VaultError(ValueError):
    """A vault that cannot be read, or must not be written there."""


class ResidualPiiError(RuntimeError):
    """Identifiers were left; nothing was written."""


def kind_of(name: str) -> str:
    """Canonical name of a kind or alias."""
    name = name.strip().lower().replace("-", "_")
    if name in ORDER:
        return name
    if name in ALIASES:
        return ALIASES[name]
    raise PolicyError(f"unknown kind: {name}")


def action_of(name: str) -> str:
    name = name.strip().lower()
    if name not in ACTIONS:
        raise PolicyError(f"unknown action: {name}")
    return name
