"""Tolerant reading of issue lists from free model text."""

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys below which a list of issues may lie.
LIST_KEYS = ["issues", "results", "findings", "problems", "data"]
OUT = "response_id long, ord int, type string, severity string, file string, line int"


def load(text: str):
    """The JSON of ``text``, comments and trailing commas aside; None if there is none."""
    for t in (text, re.sub(r",\s*([\]}])", r"\1", re.sub(r"(?m)(^|\s)//[^\n]*", r"\1", text))):
        try:
            return json.loads(t)
        except ValueError:
            pass
    return None


def issues(text: str | None) -> list[dict]:
    """Issues of a response: JSON lines, a fenced or bare array or object, or what a cut-off array holds."""
    text = (text or "").strip()
    if not text:
        return []
    rows = [load(x) for x in text.splitlines() if x.strip()]
    if len(rows) > 1 and all(isinstance(x, dict) for x in rows):
        return rows
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text[m.start() :] for m in [re.search(r"[\[{]", text)] if m]:
        end = max(part.rfind("]"), part.rfind("}")) + 1
        got = load(part[:end]) if end else None
        if isinstance(got, dict):
            inner = next((got[k] for k in LIST_KEYS if isinstance(got.get(k), list)), None)
            got = inner if inner is not None else [got]
        if isinstance(got, list):
            return [x for x in got if isinstance(x, dict)]
    return [x for x in map(load, re.findall(r"\{[^{}]*\}", text)) if isinstance(x, dict)]


def parse_responses(responses: DataFrame, id: str = "response_id", text: str = "text") -> DataFrame:
    """One row for each issue.  Clean arrays are read natively; only the rest go through Python."""
    shape = "array<struct<type:string,severity:string,file:string,line:int>>"
    x = responses.select(F.col(id).cast("long").alias("response_id"), F.col(text).alias("text"))
    x = x.withColumn("clean", F.when(F.rlike("text", F.lit(r"^\s*\[\s*\{[^\[\]]*\}\s*\]\s*$")) & F.try_parse_json("text").isNotNull(), F.from_json("text", shape)))
    fast = x.where("clean IS NOT NULL").select("response_id", F.posexplode("clean").alias("ord", "i")).select("response_id", "ord", "i.*")

    def run(batches):
        for pdf in batches:
            rows = []
            for i, t in zip(pdf["response_id"], pdf["text"]):
                for k, x in enumerate(issues(t)):
                    line = x.get("line")
                    rows.append((i, k, x.get("type"), x.get("severity"), x.get("file"), int(line) if str(line).lstrip("-").isdigit() else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
            yield out.astype({"line": "Int32"})

    return fast.unionByName(x.where("clean IS NULL").select("response_id", "text").mapInPandas(run, OUT))
