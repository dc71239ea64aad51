"""Stages that run the caller's models over rows, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

DETECTIONS = "x1 double, y1 double, x2 double, y2 double, confidence double, class_name string"


def scored(frames: DataFrame, make: Callable[[], Callable], keep: list[str], schema: str = DETECTIONS, batch: int = 32) -> DataFrame:
    """Rows of keep with what the model finds in each frame, and det_rank by confidence. make() is called once for each
    task and returns a model: a list of frames (dicts) to a list, as long, of lists of boxes (dicts). The result does
    not depend on the batch size unless the model's does."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterable):
        import pandas as pd

        model = make()
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                found = model(part)
                if len(found) != len(part):
                    raise ValueError("a model must return one list for each frame")
                for row, boxes in zip(part, found, strict=True):
                    order = sorted(range(len(boxes)), key=lambda i, b=boxes: -b[i]["confidence"])
                    out += [[row[k] for k in keep] + [boxes[i].get(n) for n in names] + [r] for r, i in enumerate(order)]
            yield pd.DataFrame(out, columns=[*keep, *names, "det_rank"])

    kept = frames.select(*keep).schema
    for f in frames.sparkSession.createDataFrame([], schema).schema.fields:
        kept = kept.add(f)
    return frames.mapInPandas(run, kept.add("det_rank", "integer"))


def estimated(crops: DataFrame, make: Callable[[], Callable], keep: list[str], schema: str, batch: int = 32) -> DataFrame:
    """Rows of keep with the model's result for each crop and an outcome: one failure makes that row null with outcome
    `infer_error` (a batch that fails is tried again row by row), never the run."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterable):
        import pandas as pd

        model = make()

        def attempt(part: list[dict]) -> list:
            try:
                return model(part)
            except Exception:
                return [RuntimeError()] if len(part) == 1 else [x for row in part for x in attempt([row])]

        for pdf in batches:
            rows = pdf.to_dict("records")
            out = []
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                for row, found in zip(part, attempt(part), strict=True):
                    failed = isinstance(found, Exception)
                    outcome = "infer_error" if failed else "infer_none" if found is None else "success"
                    values = [None] * len(names) if failed or found is None else [found.get(n) for n in names]
                    out.append([row[k] for k in keep] + values + [outcome])
            yield pd.DataFrame(out, columns=[*keep, *names, "outcome"])

    kept = crops.select(*keep).schema
    for f in crops.sparkSession.createDataFrame([], schema).schema.fields:
        kept = kept.add(f)
    return crops.mapInPandas(run, kept.add("outcome", "string"))


def classified(detections: DataFrame, keys: list[str], classify: Callable, order: str = "mono_ts") -> DataFrame:
    """keys, guess, confidence, needs_label of the caller's classify(rows of one event in order: a pandas frame), which
    returns (guess, confidence). Events are bounded by their duration, so a group is small."""

    def run(pdf):
        import pandas as pd

        guess, confidence = classify(pdf.sort_values(order))
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), guess, float(confidence), True]], columns=[*keys, "guess", "confidence", "needs_label"])

    schema = detections.select(*keys).schema.add("guess", "string").add("confidence", "double").add("needs_label", "boolean")
    return detections.groupBy(*keys).applyInPandas(run, schema)
