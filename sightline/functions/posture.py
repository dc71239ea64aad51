"""Keypoints to posture. points: map<string, struct<x, y, confidence>>."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The candidates of each role in order, and the torso points.
ROLES = {
    "neck": ("neck_base",), "withers": ("back_base", "neck_end"), "spine_mid": ("back_middle",), "hips": ("back_end", "tail_base"),
    "tail_base": ("tail_base", "back_end"), "tail_end": ("tail_end",), "hind_left_paw": ("back_left_paw",), "hind_right_paw": ("back_right_paw",),
    "front_left_paw": ("front_left_paw",), "front_right_paw": ("front_right_paw",), "belly": ("belly_bottom",), "head": ("nose",),
}
TORSO = ("neck_base", "back_base", "back_middle", "back_end", "tail_base")
FEATURES = ("spine_angle_deg", "hip_offset_ratio", "hind_paw_drop_ratio", "tail_angle_deg", "hind_paw_asymmetry")


def point(points: Column, name: str, min_conf: float) -> Column:
    p = F.try_element_at(points, F.lit(name))
    return F.when(p["confidence"] >= min_conf, F.struct(p["x"].alias("x"), p["y"].alias("y")))


def role(points: Column, name: str, min_conf: float) -> Column:
    return F.coalesce(*(point(points, n, min_conf) for n in ROLES[name]))


def torso_count(points: Column, min_conf: float) -> Column:
    return reduce(lambda a, b: a + b, [point(points, n, min_conf).isNotNull().cast("int") for n in TORSO])


def _minus(a: Column, b: Column) -> tuple[Column, Column]:
    return a["x"] - b["x"], a["y"] - b["y"]


def _length(v: tuple[Column, Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1])


def angle_between(v: tuple[Column, Column], w: tuple[Column, Column]) -> Column:
    """Degrees; null for a vector without length."""
    cosine = (v[0] * w[0] + v[1] * w[1]) / F.nullif(_length(v) * _length(w), F.lit(0.0))
    degrees = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    return F.when((_length(v) > 0) & (_length(w) > 0), degrees)


def angle_at(a: Column, vertex: Column, c: Column) -> Column:
    return angle_between(_minus(a, vertex), _minus(c, vertex))


def signed_distance(p: Column, a: Column, b: Column, belly: Column) -> Column:
    """From the line a-b; positive on the belly's side, without one downwards in the image."""
    axis = _minus(b, a)
    cross = lambda q: axis[0] * _minus(q, a)[1] - axis[1] * _minus(q, a)[0]
    size = _length(axis)
    turned = F.when(belly.isNotNull(), cross(belly) < 0).otherwise(-axis[0] < 0)
    signed = cross(p) / F.nullif(size, F.lit(0.0))
    return F.when(size > 0, F.when(turned, -signed).otherwise(signed))


def body_scale(points: Column, min_conf: float, crop: Column | None = None) -> Column:
    """struct(scale, quality): the torso's length, else the crop's diagonal (crop: struct x1..y2), else none."""
    neck, withers, hips = (role(points, r, min_conf) for r in ("neck", "withers", "hips"))
    long, short = _length(_minus(neck, hips)), _length(_minus(withers, hips))
    torso = F.when(long.isNotNull() & short.isNotNull(), (long + short) / 2).otherwise(F.coalesce(long, short))
    made = lambda s, q: F.struct(s.cast("double").alias("scale"), F.lit(q).alias("quality"))
    out = F.when(torso > 0, made(torso, "torso"))
    if crop is not None:
        w, h = F.greatest(crop["x2"] - crop["x1"], F.lit(0.0)), F.greatest(crop["y2"] - crop["y1"], F.lit(0.0))
        out = out.when(F.sqrt(w * w + h * h) > 0, made(F.sqrt(w * w + h * h), "bbox_fallback"))
    return out.otherwise(made(F.lit(None), "none"))


def torso_centroid(points: Column, min_conf: float) -> Column:
    found = F.filter(F.array(*(point(points, n, min_conf) for n in TORSO)), lambda p: p.isNotNull())
    mean = lambda f: F.aggregate(F.transform(found, lambda p: p[f]), F.lit(0.0), lambda a, x: a + x) / F.size(found)
    return F.when(F.size(found) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


USED = ("neck", "withers", "spine_mid", "hips", "tail_base", "tail_end", "hind_left_paw", "hind_right_paw", "belly")
#: What frames gives of a pose: scale and quality, FEATURES, and the centroid.
FRAME = f"scale double, quality string, {', '.join(f'{f} double' for f in FEATURES)}, centroid struct<x:double,y:double>"


def _points(column, min_conf: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of an Arrow array of maps: the (x, y) of each name used, NaN where it is missing or unsure; and, for each row, of
    how many torso points."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    names, items = column.keys.slice(first, last - first), column.items.slice(first, last - first)
    at = np.repeat(np.arange(n), sizes)
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    x, y, sure = (pc.struct_field(items, f).to_numpy(zero_copy_only=False).astype(float) for f in ("x", "y", "confidence"))
    sure = (sure >= min_conf) & items.is_valid().to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(names)
    codes, known = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    found = {}
    for name in sorted({c for r in USED for c in ROLES[r]} | set(TORSO)):
        found[name] = np.full((n, 2), np.nan)
        if name in known:
            mine = sure & (codes == known.index(name))
            found[name][at[mine]] = np.stack((x[mine], y[mine]), axis=1)
    return found, sum((~np.isnan(found[name][:, 0])).astype(int) for name in TORSO)


def _first(*choices: np.ndarray) -> np.ndarray:
    """The first that is known."""
    out = choices[0].copy()
    for more in choices[1:]:
        gaps = np.isnan(out)
        out[gaps] = more[gaps]
    return out


def _long(v: np.ndarray) -> np.ndarray:
    return np.sqrt(v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1])


def _angle(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    cosine = np.clip((v[:, 0] * w[:, 0] + v[:, 1] * w[:, 1]) / (_long(v) * _long(w)), -1.0, 1.0)
    return np.where((_long(v) > 0) & (_long(w) > 0), np.degrees(np.arccos(cosine)), np.nan)


def frames(points, crop, min_conf: float) -> tuple[list, np.ndarray]:
    """For Arrow arrays of points and crops (struct x1..y2): the columns of FRAME, as the functions above have them one by
    one, for a batch at once; and how many torso points each row has. Without a scale there are no features."""
    import pyarrow as pa
    import pyarrow.compute as pc

    with np.errstate(divide="ignore", invalid="ignore"):
        found, torso = _points(points, min_conf)
        role = {r: _first(*(found[c] for c in ROLES[r])) for r in USED}
        long, short = _long(role["neck"] - role["hips"]), _long(role["withers"] - role["hips"])
        size = _first((long + short) / 2, long, short)
        side = lambda low, high: np.nan_to_num(np.maximum(pc.struct_field(crop, high).to_numpy(zero_copy_only=False).astype(float) - pc.struct_field(crop, low).to_numpy(zero_copy_only=False).astype(float), 0.0))
        w, h = side("x1", "x2"), side("y1", "y2")
        diagonal = np.sqrt(w * w + h * h)
        fine = np.where(size == 0, np.nan, size)
        scale = np.where(np.isnan(fine), np.where(diagonal > 0, diagonal, np.nan), fine)
        quality = np.where(~np.isnan(fine), "torso", np.where(diagonal > 0, "bbox_fallback", "none"))
        neck, axis = role["neck"], role["spine_mid"] - role["neck"]
        cross = lambda q: axis[:, 0] * (q - neck)[:, 1] - axis[:, 1] * (q - neck)[:, 0]
        belly = role["belly"]
        turned = np.where(np.isnan(belly[:, 0]), -axis[:, 0] < 0, cross(belly) < 0)

        def line(p: np.ndarray) -> np.ndarray:
            signed = cross(p) / _long(axis)
            return np.where(_long(axis) > 0, np.where(turned, -signed, signed), np.nan)

        left, right = role["hind_left_paw"], role["hind_right_paw"]
        hips, paws = line(role["hips"]), line(_first((left + right) / 2, left, right))
        features = {
            "spine_angle_deg": _angle(role["withers"] - role["spine_mid"], role["hips"] - role["spine_mid"]),
            "hip_offset_ratio": hips / scale,
            "hind_paw_drop_ratio": (paws - hips) / scale,
            "tail_angle_deg": _angle(role["hips"] - role["spine_mid"], role["tail_end"] - role["tail_base"]),
            "hind_paw_asymmetry": np.abs(line(left) - line(right)) / scale,
        }
        middle = sum((np.nan_to_num(found[t]) for t in TORSO), np.zeros((len(scale), 2))) / torso[:, None]
    none = np.isnan(scale)
    known = lambda values: pa.array(values, mask=np.isnan(values) | none)
    centroid = pa.StructArray.from_arrays([pa.array(middle[:, 0]), pa.array(middle[:, 1])], names=["x", "y"], mask=pa.array(none | (torso == 0)))
    return [known(scale), pa.array(quality, pa.string()), *(known(features[f]) for f in FEATURES), centroid], torso


def decision(spine: Column, hip: Column, motion: Column, tail: Column, dwell: Column, asymmetry: Column) -> Column:
    """struct(guess, confidence), or null where fewer than two geometric signals, or no core one, are known."""
    known = [c.isNotNull().cast("int") for c in (spine, hip, motion, tail)]
    n = reduce(lambda a, b: a + b, known)
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    hits = yes(spine < 150.0) + yes(hip > 0.12) + yes(motion < 0.6) + yes(tail >= 110.0) + yes(dwell >= 5.0)
    share = hits / (n + 1)
    lift = F.coalesce(asymmetry >= 0.25, F.lit(False))
    poop = F.struct(F.lit("poop").alias("guess"), F.least(F.lit(0.65), 0.40 + 0.25 * share).alias("confidence"))
    sure = F.least(F.lit(0.6), 0.35 + 0.20 * (1.0 - share))
    pee = F.struct(F.lit("pee").alias("guess"), F.when(lift, F.least(F.lit(0.6), sure + 0.1)).otherwise(sure).alias("confidence"))
    return F.when((n >= 2) & (spine.isNotNull() | hip.isNotNull()), F.when((share >= 0.6) & ~lift, poop).otherwise(pee))


def guess(posture_guess: Column, trusted: Column, box_guess: Column) -> Column:
    """The posture's guess where it is trusted, else the boxes'."""
    return F.coalesce(F.when(trusted, posture_guess), box_guess)


def model_points(values: Column, names: list[str], origin: Column) -> Column:
    """struct(points, outcome) of a model's individuals x points x (x, y, confidence): the first individual, shape
    checked, points that are not finite dropped, the crop's corner (struct x1, y1) added."""
    first = F.get(values, F.lit(0))
    shaped = (F.size(values) > 0) & (F.size(first) == len(names)) & F.forall(first, lambda p: F.size(p) == 3)
    finite = lambda p: F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    entries = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("n"), first.alias("p")), lambda z: F.struct(z["n"].alias("key"), z["p"].alias("p")))
    kept = F.filter(entries, lambda e: finite(e["p"]))
    made = F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], F.struct((F.get(e["p"], F.lit(0)) + origin["x1"]).alias("x"), (F.get(e["p"], F.lit(1)) + origin["y1"]).alias("y"), F.get(e["p"], F.lit(2)).alias("confidence")))))
    outcome = F.when(values.isNull(), "infer_none").when(~F.coalesce(shaped, F.lit(False)), "bad_shape").when(F.size(kept) == 0, "no_finite_keypoints").otherwise("success")
    return F.struct(F.when(outcome == "success", made).alias("points"), outcome.alias("outcome"))
