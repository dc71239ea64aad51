"""Strings, keys and enumerations: secret-free ids, path parts, deterministic ids and splits, vocabularies, states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that hold secrets.
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "auth", "key", "password", "pass", "sig", "signature", "token", "x-api-key")
#: Vocabularies of labels.
BEHAVIORS = ("pee", "poop", "not_potty", "excluded")
TRAINABLE = ("pee", "poop", "not_potty")
LABELS = ("pee", "poop", "not_potty", "unknown")
STATUSES = ("unlabeled", "labeled", "rejected", "uncertain")
IDENTITIES = ("gromit", "walle", "apollo", "unknown")
SUBJECT = "dog"


def secret_free(source: Column) -> Column:
    """A URL without user info, fragment and secret query keys; any other text as it is."""
    url = source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+")
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(F.regexp_extract(source, r"^[^:]+://([^/?#]*)", 1), r"^.*@", "")
    path = F.regexp_extract(source, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(source, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*SENSITIVE_KEYS))
    pairs = F.transform(pairs, lambda p: F.when(F.instr(p, "=") > 0, p).otherwise(F.concat(p, F.lit("="))))
    kept = F.array_join(pairs, "&")
    return F.when(url, F.concat(scheme, F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))).otherwise(source)


def path_part(value: Column) -> Column:
    safe = F.regexp_replace(secret_free(F.coalesce(value.cast("string"), F.lit(""))), r"[^A-Za-z0-9._-]+", "_")
    safe = F.regexp_replace(F.regexp_replace(safe, "_+", "_"), r"^[._]+|[._]+$", "")
    return F.when(safe == "", "unknown").otherwise(safe)


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def event_path(camera_id: Column, camera_name: Column, start: Column, track_id: Column, event_id: Column) -> Column:
    """<camera>/<date>/events/<stamp>_<camera>_<track>_<id>."""
    camera = path_part(F.coalesce(F.nullif(camera_name, F.lit("")), camera_id))
    name = F.concat_ws("_", utc_stamp(start), camera, path_part(track_id), path_part(event_id))
    return F.concat_ws("/", camera, F.date_format(start, "yyyy-MM-dd"), F.lit("events"), name)


def span_id(source_id: Column, start_frame: Column, end_frame: Column, track_id: Column) -> Column:
    text = lambda c: c.cast("string")
    digest = F.substring(F.sha1(F.concat_ws("|", source_id, text(start_frame), text(end_frame), text(track_id))), 1, 10)
    return F.concat(F.lpad(text(start_frame), 7, "0"), F.lit("_"), F.lpad(text(end_frame), 7, "0"), F.lit("_t"), text(track_id), F.lit("_"), digest)


def split_of(key: Column, val_fraction: float) -> Column:
    """train or val by a hash of the key; the same key always falls the same way."""
    if val_fraction <= 0 or val_fraction >= 1:
        return F.lit("train" if val_fraction <= 0 else "val")
    share = F.conv(F.substring(F.sha1(key), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    return F.when(share < val_fraction, "val").otherwise("train")


def split_key(source_id: Column, day: Column) -> Column:
    return F.concat_ws("|", path_part(source_id), day)


def alias_classes(names: Column) -> Column:
    """Trimmed, lower-case, without blanks and the subject itself, each once in order."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.lower(F.trim(n))), lambda n: (n != "") & (n != SUBJECT)))


def roster(names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))


def identity(name: Column, known: Column) -> Column:
    """The entry of known that is equal but for case, dashes, underscores and outer spaces; else `unknown`."""
    plain = lambda c: F.lower(F.translate(F.trim(c), "-_", ""))
    return F.coalesce(F.get(F.filter(known, lambda k: plain(k) == plain(name)), F.lit(0)), F.lit("unknown"))


def is_trainable(behavior: Column) -> Column:
    return F.coalesce(behavior.isin(*TRAINABLE), F.lit(False))


def bad_range(start_frame: Column, end_frame: Column, start_s: Column, end_s: Column) -> Column:
    """Why a label range is refused, or null."""
    return (
        F.when(start_frame.isNull() | end_frame.isNull(), "missing frame").when(start_frame < 0, "negative start").when(end_frame < start_frame, "end before start")
        .when(end_s < start_s - 1e-6, "end time before start time")
    )


def human_signal(status: Column, label: Column, name: Column, note: Column, labeled_at: Column) -> Column:
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return (given(status) & (status != "unlabeled")) | (given(label) & (label != "unknown")) | given(name) | given(note) | given(labeled_at)


def event_state(human: Column, end_ts: Column, recorded_at: Column, source_exists: Column) -> Column:
    """labeled, deterministic, source_missing or removable: in this order."""
    legacy = end_ts.isNull() & recorded_at.isNull()
    return F.when(human, "labeled").when(~legacy, "deterministic").when(~source_exists, "source_missing").otherwise("removable")


def lenient_double(value: Column) -> Column:
    """A JSON value as text to a number; booleans and other texts are null."""
    return F.when(~F.lower(value).isin("true", "false"), value.try_cast("double"))


def lenient_choice(value: Column, choices: tuple[str, ...], default: str) -> Column:
    return F.when(F.lower(value).isin(*choices), F.lower(value)).otherwise(default)


def numeric_first(track_id: Column) -> tuple[Column, Column]:
    """Sort keys: the id's integer value, 0 if it has none, then its text."""
    return F.coalesce(track_id.try_cast("int"), F.lit(0)), track_id
