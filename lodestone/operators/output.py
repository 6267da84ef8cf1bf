"""Results as JSON within limits, and diagnostics. Runs on the driver, on at most the k rows of an answer."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.paths import glob_regex

#: Set to show scores and ranks in results.
DEBUG = "LODESTONE_DEBUG"
#: Text lengths and numbers of children that are tried in turn; diagnostics shown beside the first.
TEXT_STEPS, CHILD_STEPS, SAMPLES = (200, 80, 20, 0), (5, 1, 0), 5


def distinct_diagnostics(details: DataFrame) -> DataFrame:
    """Of rows (pos, code, message, path, chunk_id) that agree in all but pos, the first."""
    return details.groupBy("code", "message", "path", "chunk_id").agg(F.min("pos").alias("pos"))


def summarise_diagnostics(details: DataFrame) -> DataFrame:
    """(code, n, first, others, suppressed): counts by code, the first message, up to five others that differ from it."""
    per = details.groupBy("code", "message").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    order = Window.partitionBy("code").orderBy("pos", "message")
    numbered = per.withColumn("place", F.row_number().over(order))
    return numbered.groupBy("code").agg(
        F.sum("n").alias("n"), F.min_by("message", "place").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("place") > 1) & (F.col("place") <= 1 + SAMPLES), F.struct("place", "message")))), lambda x: x["message"]), "|").alias("others"),
        F.sum(F.when(F.col("place") > 1 + SAMPLES, 1).otherwise(0)).alias("suppressed"),
    )


@dataclass(frozen=True)
class Limits:
    max_bytes: int | None = None
    max_lines: int | None = None


def fits(text: str, limits: Limits) -> bool:
    return (limits.max_bytes is None or len(text.encode()) <= limits.max_bytes) and (limits.max_lines is None or text.count("\n") + 1 <= limits.max_lines)


def cut_utf8(text: str, max_bytes: int) -> str:
    return text.encode()[: max(0, max_bytes)].decode("utf-8", "ignore")


def pretty(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def distinct_strings(diagnostics: list[str]) -> list[str]:
    """In order of their first places."""
    return list(dict.fromkeys(diagnostics))


def visible_status(status: dict, paths: list[str]) -> dict:
    """Without internal counts, and with those globs only that take one of the paths; the glob for everything isn't worth showing."""
    shown = {k: v for k, v in status.items() if k not in ("filtered_count", "candidate_count", "best_score", "config_hash")}
    for name in ("include", "exclude"):
        if name in shown:
            shown[name] = [g for g in shown[name] if g != "**/*" and any(re.match(glob_regex(g), p) for p in paths)]
    return shown


def visible(result: dict, debug: bool | None = None) -> dict:
    """Without scores, unless asked for (by default: in the environment)."""
    return result if (bool(os.environ.get(DEBUG)) if debug is None else debug) else {k: v for k, v in result.items() if k not in ("score", "final_score", "retrieval")}


def minimal(output: dict) -> dict:
    rows = [{"rank": i + 1, **{k: r[k] for k in ("id", "label", "range", "score", "retrieval") if k in r}} for i, r in enumerate(output["results"])]
    return {"status": output["status"], "results": rows, "diagnostics": output["diagnostics"], "compacted": True}


def compacted(output: dict):
    """Smaller and smaller forms: without parents, then with shorter texts and fewer children."""
    bare = [{k: v for k, v in r.items() if k not in ("parent_text", "parent_range")} for r in output["results"]]
    yield {**output, "results": bare, "compacted": True}
    for length in TEXT_STEPS:
        for children in (None, *CHILD_STEPS):
            rows = []
            for r in bare:
                row = dict(r)
                if isinstance(row.get("text"), str):
                    row["text"] = row["text"][:length]
                if children is not None and isinstance(row.get("children"), list):
                    row["children"] = row["children"][:children]
                rows.append(row)
            yield {**output, "results": rows, "compacted": True}


def compacted_lookup(output: dict):
    """Of a looked-up chunk: shorter texts, and for each length fewer children, with a page that says how many are shown."""
    for length in (200, 80, 0):
        for most in (None, *CHILD_STEPS):
            small = {**output, "compacted": True}
            for name in ("parent", "previous", "next"):
                if isinstance(small.get(name), str):
                    small[name] = small[name][:length]
            if small.get("chunk"):
                small["chunk"] = {**small["chunk"], "text": (small["chunk"].get("text") or "")[:length]}
            children = output.get("children") or []
            small["children"] = [c[:length] for c in children[: len(children) if most is None else most]]
            if page := output.get("children_page"):
                small["children_page"] = {**page, "shown": len(small["children"]), "has_more": page["offset"] + len(small["children"]) < page["total"]}
            yield small


def serialise_lookup(output: dict, limits: Limits = Limits()) -> str:
    """The largest form that fits; at last the chunk's name alone, or cut by force."""
    least = {"chunk": {k: (output.get("chunk") or {}).get(k) for k in ("id", "path", "line_start", "line_end")}, "diagnostics": output["diagnostics"], "compacted": True}
    forms = [pretty(output), *map(pretty, compacted_lookup(output)), json.dumps(least, ensure_ascii=False)]
    return next((f for f in forms if fits(f, limits)), cut_utf8(forms[-1], limits.max_bytes or 0))


def serialise(output: dict, limits: Limits = Limits()) -> str:
    """The largest form that fits: whole, compacted, minimal, minimal on one line, diagnostics alone, or cut by force."""
    forms = [pretty(output), *map(pretty, compacted(output)), pretty(minimal(output)), json.dumps(minimal(output), ensure_ascii=False)]
    forms.append(json.dumps({"diagnostics": output["diagnostics"], "compacted": True}, ensure_ascii=False))
    for form in forms:
        if fits(form, limits):
            return form
    lines = forms[-1].split("\n")[: limits.max_lines] if limits.max_lines is not None else [forms[-1]]
    text = "\n".join(lines)
    return text if limits.max_bytes is None else cut_utf8(text, limits.max_bytes)
