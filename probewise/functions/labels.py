"""Subject labels: search, cleaning, identity keys, ids, thresholds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from probewise.functions.vectors import as_column

# fixed values: labels of bulk test data
SCALE_PREFIXES = ("Dataset Identity ", "Scale Person ")
SCALE_MARK = "#SCALE"
LABEL_PREFIX = "AC_"

# fixed values: default match threshold, and the split folder names
MATCH_THRESHOLD = 0.4
SPLIT_FOLDERS = ("train", "val", "test")


def strip(text: Column | str) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(as_column(text), r"^\s+|\s+$", "")


def canonical_uuid(text: Column | str) -> Column:
    """Dashed lower-case form of a 32- or 36-character id; null for other text."""
    bare = F.replace(F.lower(strip(text)), F.lit("-"), F.lit(""))
    dashed = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), dashed)


def matches_query(label: Column | str, subject_id: Column | str, query: str | None) -> Column:
    """Label contains ``query`` whatever the case, or the id equals it; blank matches all."""
    query = (query or "").strip()
    if not query:
        return F.lit(True)
    by_label = F.lower(as_column(label)).contains(query.lower())
    subject_id = as_column(subject_id).cast("string")
    by_id = F.coalesce(canonical_uuid(subject_id), subject_id) == F.coalesce(canonical_uuid(F.lit(query)), F.lit(query))
    return F.coalesce(by_label, F.lit(False)) | F.coalesce(by_id, F.lit(False))


def is_scale_label(label: Column | str) -> Column:
    label = as_column(label)
    found = F.upper(label).contains(SCALE_MARK)
    for prefix in SCALE_PREFIXES:
        found = found | label.startswith(prefix)
    return F.coalesce(found, F.lit(False))


def clean_label(label: Column | str) -> Column:
    bare = F.regexp_replace(as_column(label), f"^{LABEL_PREFIX}", "")
    return strip(F.replace(bare, F.lit("_"), F.lit(" ")))


def fold_case(text: Column | str) -> Column:
    """Lower case of the upper case, so that ``ß`` and ``ss`` are one; the dotless i stays apart."""
    kept = F.translate(as_column(text), "\u0131", "\ue131")
    return F.translate(F.lower(F.upper(kept)), "\ue131", "\u0131")


def identity_key(label: Column | str, subject_id: Column | str) -> Column:
    """The label with its case folded, or the subject id where there is no label."""
    bare = fold_case(strip(label))
    return F.when(F.coalesce(bare, F.lit("")) != "", F.concat(F.lit("label:"), bare)).otherwise(
        F.concat(F.lit("person:"), as_column(subject_id).cast("string"))
    )


def threshold_for(space: Column | str, is_live: Column | str, settings: Mapping[str, float | None]) -> Column:
    """Decision threshold; an unset (null) one falls through to the next."""
    space, is_live = as_column(space), as_column(is_live)

    def setting(name: str) -> Column:
        return F.lit(settings.get(name)).cast("double")

    return F.coalesce(
        F.when((space == "custom") & is_live, setting("custom_live")),
        F.when(space == "custom", setting("custom")),
        F.when(space == "pretrained", setting("pretrained")),
        setting("default"),
        F.lit(MATCH_THRESHOLD),
    )


def identity_from_path(path: Column | str, roots: list[str]) -> Column:
    """Identity folder of a file path under the first matching root."""
    path = as_column(path)
    folders = F.split(path, "/")
    result = F.when(F.size(folders) > 1, F.element_at(folders, -2)).otherwise("")
    for root in reversed(roots):
        root = root.rstrip("/")
        below = F.split(F.substring(path, len(root) + 2, 1 << 30), "/")
        first = below[0]
        named = (
            F.when((F.size(below) > 2) & F.lower(first).isin(*SPLIT_FOLDERS), F.get(below, F.lit(1)))
            .when(F.size(below) > 1, first)
            .otherwise(root.rsplit("/", 1)[-1])
        )
        result = F.when(path.startswith(root + "/"), named).otherwise(result)
    return result
