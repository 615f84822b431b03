"""Names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def display_name(path: Column) -> Column:
    """The base name after its last double underscore."""
    return F.element_at(F.split(base_name(path), "__"), -1)


def stem(name: Column) -> Column:
    """The base name without its extension, lower-cased; a leading dot begins no extension."""
    return F.lower(F.regexp_replace(base_name(name), r"(?<=[^.])\.[^.]*$", ""))


def trimmed(text: Column) -> Column:
    """Without the spaces and zero bytes around it; null reads as empty."""
    return F.coalesce(F.btrim(text, F.lit(" \x00")), F.lit(""))


# Content types and extensions, and the patterns of names, tokens and sessions below.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "text/plain": ".txt", "text/xml": ".xml", "application/json": ".json"}
PHOTO_TYPES = ("image/jpeg", "image/png")


def safe_name(name: Column, content_type: Column) -> Column:
    """A file name of harmless characters with the type's extension."""
    clean = F.left(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9.-]+", "_"), F.lit("._")), F.lit(80))
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit("photo"))
    low = F.lower(clean)
    own = F.when(content_type.isin(*PHOTO_TYPES), low.endswith(".jpg") | low.endswith(".jpeg") | low.endswith(".png"))
    suffix = F.lit(None).cast("string")
    for kind, ext in EXTENSIONS.items():
        suffix = F.when(content_type == kind, F.lit(ext)).otherwise(suffix)
    own = own.otherwise(F.endswith(low, suffix))
    return F.when(own, clean).otherwise(F.concat(clean, suffix))


def owner_of(guest: Column) -> Column:
    """A guest token's public owner id; null for what is no token."""
    return F.when(guest.rlike("^[0-9a-f]{64}$"), F.left(F.sha2(guest, 256), F.lit(32)))


def valid_session(session: Column) -> Column:
    return F.coalesce(session.rlike("^[0-9a-f]{32}$"), F.lit(False))


def public_key(key: Column, real: Column, alias: Column) -> Column:
    """The key under its alias, so that a guest's folder never shows."""
    hidden = alias.isNotNull() & (alias != "") & F.startswith(key, real)
    return F.when(hidden, F.concat(alias, key.substr(F.char_length(real) + 1, F.char_length(key)))).otherwise(key)


def local_name(key: Column, prefix: Column, alias: Column) -> Column:
    """A flat local name for an object."""
    named = F.when(alias.isNotNull() & (alias != ""), F.concat(alias, key.substr(F.char_length(prefix) + 1, F.char_length(key)))).otherwise(key)
    return F.replace(named, F.lit("/"), F.lit("__"))


def session_layout(session: Column, base: Column) -> Column:
    """Where a session's files are, and what their local copies are named after."""
    kept = base.isNotNull() & (base != "")
    plain = F.concat(F.lit("uploads/"), session, F.lit("/"))
    source = F.when(kept, base).otherwise(plain)
    folders = [F.concat(source, F.lit(f"{x}/")).alias(x) for x in ("images", "test", "labels", "quarantine")]
    return F.struct(*folders, F.when(kept, plain).alias("alias"))
