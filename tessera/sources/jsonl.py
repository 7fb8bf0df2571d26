"""JSON and JSONL files: evaluation rows, generations behind a header line, caches, grades and pairs.

These files are logs of one run, read whole so that lines keep their numbers; large
tables are Parquet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import checks


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value) of every terminated line, line from 0; what follows the last line break is left out."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    last = F.max("line").over(Window.partitionBy("file"))
    return whole.withColumn("_last", last).where("line < _last").drop("_last")


def eval_rows(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A JSON array of rows with index, its place in the array; limit keeps the first rows."""
    raw = spark.read.text(path, wholetext=True)
    row = "struct<instruction:string,input:string,output:string>"
    rows = raw.select(F.posexplode(F.from_json("value", f"array<{row}>")).alias("index", "r")).select(F.col("index").cast("long"), "r.*")
    return rows if limit is None else rows.where(F.col("index") < limit)


def records(spark: SparkSession, path: str | list[str], schema: str, key: dict[str, Any] | None = None) -> DataFrame:
    """Records behind the header line, up to the first line that is not a JSON object; none of a file whose header isn't `key`."""
    numbered = lines(spark, path)
    if key is not None:
        headers = numbered.where("line = 0").select("file", "value").collect()  # one for each file
        good = [(r.file,) for r in headers if same_key(r.value, key)]
        numbered = numbered.join(F.broadcast(spark.createDataFrame(good, "file string")), "file", "left_semi")
    parsed = numbered.where("line > 0").withColumn("r", F.from_json("value", f"struct<{as_struct(schema)},_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    cut = parsed.groupBy("file").agg(F.min(F.when(bad, F.col("line"))).alias("_cut"))
    kept = parsed.join(F.broadcast(cut), "file").where(F.col("_cut").isNull() | (F.col("line") < F.col("_cut")))
    return kept.select((F.col("line") - 1).alias("record"), "r.*").drop("_corrupt")


def as_struct(schema: str) -> str:
    """`a int, b string` as `a:int,b:string`."""
    return ",".join(":".join(re.split(r"\s+", c.strip(), maxsplit=1)) for c in re.split(r",(?![^<]*>)", schema))


def same_key(line: str, key: dict[str, Any]) -> bool:
    try:
        header = json.loads(line)
    except ValueError:
        return False
    return isinstance(header, dict) and header.get("cache_key") == json.loads(json.dumps(key))


def read_header(path: str | Path) -> dict[str, Any] | None:
    """The header line, or None if it is absent, cut short or not an object."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        first = f.readline()
    try:
        header = json.loads(first) if first.endswith("\n") else None
    except ValueError:
        return None
    return header if isinstance(header, dict) else None


def grades(spark: SparkSession, path: str) -> DataFrame:
    """(grader, index, label, grade, reason) of grades_<grader>.jsonl files; faults name the file and line."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line", "value"))
    named = text.where(F.trim("value") != "").withColumn("grader", F.regexp_replace(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1), "^grades_", ""))
    parsed = named.withColumn("r", F.from_json("value", "struct<index:long,label:string,grade:string,reason:string,_corrupt:string>", {"columnNameOfCorruptRecord": "_corrupt"}))
    fault = F.concat(F.regexp_extract("file", "([^/]+)$", 1), F.lit(" line "), (F.col("line") + 1).cast("string"), F.lit(": expected a JSON object"))
    first = parsed.where("r is null or r._corrupt is not null").agg(F.min(fault).alias("fault")).first().fault
    if first:
        raise ValueError(first)
    files = named.groupBy("grader").agg(F.countDistinct("file").alias("n")).where("n > 1").first()
    if files:
        raise ValueError(f"grader {files.grader} has {files.n} files")
    return parsed.select("grader", "r.*").drop("_corrupt")


def write_atomic(path: str | Path, text: str | Iterable[str]) -> None:
    """The file appears whole or not at all; text may come in pieces."""
    path = Path(path)
    handle, part = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            for piece in [text] if isinstance(text, str) else text:
                f.write(piece)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise


def file_sha256(path: str | Path) -> str:
    """Of a file's bytes, or of a folder's sorted names and contents."""
    path, digest = Path(path), hashlib.sha256()
    for p in [path] if path.is_file() else sorted(x for x in path.rglob("*") if x.is_file()):
        if p != path:
            digest.update(str(p.relative_to(path)).encode())
        with open(p, "rb") as f:
            while piece := f.read(1 << 20):
                digest.update(piece)
    return digest.hexdigest()


def to_jsonl(rows: DataFrame) -> DataFrame:
    """One JSON line for each row, nulls written."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_pairs(pairs: DataFrame, folder: str | Path, manifest: dict[str, Any]) -> dict[str, Any]:
    """pairs.jsonl in index order and manifest.json with its checksum; the driver holds one partition at a time."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    write_atomic(folder / "pairs.jsonl", (r.value + "\n" for r in to_jsonl(pairs.orderBy("index")).toLocalIterator()))
    full = manifest | {"pairs_sha256": file_sha256(folder / "pairs.jsonl")}
    write_atomic(folder / "manifest.json", json.dumps(full, indent=2) + "\n")
    return full


def read_pairs(spark: SparkSession, folder: str | Path, adapter_sha256: str) -> DataFrame:
    """Pairs whose manifest names the adapter and matches the file."""
    folder = Path(folder)
    manifest = json.loads((folder / "manifest.json").read_text())
    if manifest.get("adapter_sha256") != adapter_sha256:
        raise ValueError("the pairs were sampled from another adapter")
    if manifest["pairs_sha256"] != file_sha256(folder / "pairs.jsonl"):
        raise ValueError("pairs.jsonl changed since its manifest")
    return spark.read.json(str(folder / "pairs.jsonl"))


def write_sheet(sheet: DataFrame, key: DataFrame, folder: str | Path, facts: dict[str, Any]) -> None:
    """sheet.jsonl for the graders and, apart from it, key.json with each prompt's systems by label and the facts of the run.

    sheet: (index, prompt, reference, answers); key: (index, system, label). Both in index order.
    """
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    write_atomic(folder / "sheet.jsonl", (r.value + "\n" for r in to_jsonl(sheet.orderBy("index")).toLocalIterator()))
    labels = key.groupBy("index").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "system")))).alias("labels"))
    lines = (json.dumps(str(r["index"])) + ": " + json.dumps(r.labels) for r in labels.orderBy("index").toLocalIterator())

    def pieces() -> Iterable[str]:
        yield "{" + json.dumps("facts") + ": " + json.dumps(facts) + ", " + json.dumps("labels") + ": {"
        for i, line in enumerate(lines):
            yield (",\n" if i else "\n") + line
        yield "\n}}\n"

    write_atomic(folder / "key.json", pieces())


def read_sheet(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(sheet, key, facts), the sheet's prompts and the key's being the same."""
    folder = Path(folder)
    held = json.loads((folder / "key.json").read_text())
    key = spark.createDataFrame([(int(i), s, x) for i, labels in held["labels"].items() for x, s in labels.items()], "index long, system string, label string")
    sheet = spark.read.schema("index long, prompt string, reference string, answers map<string,string>").json(str(folder / "sheet.jsonl"))
    checks.check_sheet(sheet, key)
    return sheet, key, held["facts"]
