"""Script registry as column logic: lifecycle states, version gates, checksums, description headers, dispatch order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as js


def lifecycle_state(provenance: Column, enabled: Column, okayed_version: Column, okayed_checksum: Column, local_version: Column, local_checksum: Column, in_catalog: Column, catalog_version: Column, online: Column) -> Column:
    """The state of a script, with the reason of a block behind a colon; a null provenance is a script without a record."""
    curated = provenance == "curated"
    return (
        F.when(provenance.isNull(), F.when(in_catalog, "Available").otherwise("Absent"))
        .when(~enabled, "Disabled")
        .when(okayed_version.isNull(), F.when(curated, "Available").otherwise("Absent"))
        .when(local_version.isNull(), F.when(online, "Materializing").otherwise("Blocked:offline"))
        .when(local_version != okayed_version, "Materializing")
        .when(local_checksum != okayed_checksum, "Blocked:drift")
        .when(curated & (catalog_version > okayed_version), "UpdateAvailable")
        .otherwise("Active")
    )


def version_allows(available: Column, required: Column) -> Column:
    """Whether an API version offers what a script requires: both ``major.minor``, one major, a minor not above."""
    part = lambda c, i: F.regexp_replace(F.get(F.split(c, r"\."), F.lit(i)), "^0+(?=[0-9])", "")
    # Digits without zeros before them compare as numbers do, first by how many they are.
    key = lambda c, i: F.struct(F.length(part(c, i)).alias("n"), part(c, i).alias("digits"))
    well = available.rlike(r"^[0-9]+\.[0-9]+\z") & required.rlike(r"^[0-9]+\.[0-9]+\z")
    return F.coalesce(well & (part(available, 0) == part(required, 0)) & (key(required, 1) <= key(available, 1)), F.lit(False))


def checksum(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def description(source: Column) -> Column:
    """The text of the first ``// description:`` line, null without one."""
    hit = F.get(F.filter(F.split(source, "\n", -1), lambda x: x.rlike(rf"^(?i:{js.WS}*//{js.WS}*description:)")), F.lit(0))
    return F.trim(F.regexp_replace(hit, rf"^(?i:{js.WS}*//{js.WS}*description:)", ""))


def paste_order(provenance: Column, priority: Column, ident: Column) -> list[Column]:
    """Sort keys of paste handlers: curated scripts first, then falling priority, then the identifier."""
    return [F.when(provenance == "curated", 0).otherwise(1).asc(), priority.desc(), ident.asc()]


def materialize(provenance: Column, okayed_version: Column, okayed_checksum: Column, reachable: Column, entry_version: Column, entry_checksum: Column, content: Column) -> Column:
    """Why a script's file may not be written, null if it may. ``entry_*`` are the catalog's, null without an entry; ``content`` the bytes that were fetched or read,
    null if they couldn't be."""
    found = checksum(content)
    curated = (
        F.when(~reachable, "offline").when(entry_version.isNull(), "source-missing").when(content.isNull(), "offline").when(found != entry_checksum, "checksum-mismatch")
        .when((entry_version != okayed_version) | (found != okayed_checksum), "drift")
    )
    imported = F.when(content.isNull(), "source-missing").when(found != okayed_checksum, "drift")
    return F.when(okayed_version.isNull() | okayed_checksum.isNull(), "drift").when(provenance == "curated", curated).otherwise(imported)


def with_defaults(scripts: DataFrame) -> DataFrame:
    """Stored records with what they lack: provenance curated, not enabled, an approval only with both its version and checksum, no source, no command."""
    both = F.col("okayed_version").isNotNull() & F.col("okayed_checksum").isNotNull()
    filled = {"provenance": "curated", "enabled": False, "source": "", "command": False}
    out = scripts.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in scripts.columns else F.lit(v) for k, v in filled.items()})
    return out.withColumns({c: F.when(both, F.col(c)) for c in ("okayed_version", "okayed_checksum")})


def resolved(scripts: DataFrame, catalog: DataFrame | None, local: DataFrame, versions: DataFrame) -> DataFrame:
    """The state of every script of ``scripts`` (id, provenance, enabled, okayed_version, okayed_checksum) and of every other entry of the ``catalog`` (id, version),
    which is None if it can't be reached, by the files of ``local`` (id, content) and the ``versions`` (id, version) that this device wrote: id, state."""
    files = local.select("id", checksum(F.col("content")).alias("local_checksum"), F.lit(True).alias("there")).join(versions.select("id", F.col("version").alias("written")), "id", "left")
    rows = scripts if catalog is None else scripts.join(catalog.select("id", F.col("version").alias("catalog_version"), F.lit(True).alias("listed")), "id", "full_outer")
    if catalog is None:
        rows = rows.withColumn("catalog_version", F.lit(None).cast("long")).withColumn("listed", F.col("provenance") == "curated")
    rows = rows.join(files, "id", "left")
    version = F.when(F.col("there"), F.coalesce("written", "okayed_version", F.lit(0)))
    state = lifecycle_state(F.col("provenance"), F.col("enabled"), F.col("okayed_version"), F.col("okayed_checksum"), version, F.col("local_checksum"), F.coalesce("listed", F.lit(False)), F.col("catalog_version"), F.lit(catalog is not None))
    return rows.select("id", state.alias("state"))


def consent(enabled: Column, okayed_version: Column, okayed_checksum: Column, version: Column, found: Column) -> Column:
    """What to do before a script runs: ``disable`` it, run it for this session, or ``ask``."""
    same = (okayed_version == version) & (okayed_checksum == found)
    return F.when(~enabled, "disable").when(same, "enable-session").otherwise("ask")


def state_notice(state: Column, name: Column) -> Column:
    """What to say when a script that is not active is called; null for active ones."""
    reason = F.regexp_extract(state, "^Blocked:(.*)", 1)
    return (
        F.when(state == "Disabled", F.concat(F.lit('"'), name, F.lit('" is disabled')))
        .when(state.startswith("Blocked"), F.concat(F.lit('"'), name, F.lit('" is blocked ('), reason, F.lit(")")))
        .when(state == "Materializing", F.concat(F.lit('"'), name, F.lit('" is not ready yet')))
        .when(state == "UpdateAvailable", F.concat(F.lit('"'), name, F.lit('" has an update: update it to run it')))
        .when(state != "Active", F.concat(F.lit('"'), name, F.lit('" is not active')))
    )


def change_notice(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " change").otherwise(" changes"))


def is_inside(path: Column) -> Column:
    """Whether a path is relative and never goes up."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|\z)")


def script_id(path: Column) -> Column:
    """The identifier of an imported script: the name of its file."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?i)\.cjs\z", "")
