"""Writers: records as JSON, the report as CSV, run folders, timing logs, snapshots."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_json(record: Column) -> Column:
    """A record with its nulls, field names as they are."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file in the given order; null as empty, truth values as True and False."""
    cols = [F.when(F.col(f.name).isNotNull(), F.initcap(F.col(f.name).cast("string"))).alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema]
    df.select(*cols).orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_json(df: DataFrame) -> str:
    """A one-row summary as JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]


def section_dump(df: DataFrame, doc: str, section: str, text: str, order: str) -> DataFrame:
    """doc, dump: its sections of more than one word, each under a header and a rule of 80 dashes."""
    kept = df.where(F.col(text).rlike(r"(?U)\S\s+\S"))
    one = F.concat_ws("\n", F.concat(F.lit("["), F.coalesce(section, F.lit("")), F.lit("]")), F.lit("-" * 80), F.col(text))
    return kept.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), one.alias("t")))), lambda x: x["t"]), "\n\n").alias("dump"))


def next_run_folder(root: str | Path, base: str = "exp") -> Path:
    """The next run folder: `exp`, then the highest number so far plus one; a folder without one counts as 1."""
    root = Path(root)
    taken = [p.name[len(base):] for p in root.glob(f"{base}*") if p.is_dir()] if root.exists() else []
    if not taken:
        return root / base
    return root / f"{base}{max(int(t) if t.isdigit() else 1 for t in taken) + 1}"


def append_timing(path: str | Path, entry: dict[str, Any]) -> None:
    """Objects one after the other, as sources.records.concatenated_objects reads them."""
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(entry, indent=2))


def plain(value: Any) -> Any:
    """Values as JSON and YAML hold them, nested ones included."""
    if hasattr(value, "model_dump"):
        value = value.model_dump()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def snapshot(folder: str | Path, config: dict[str, Any], prompts: dict[str, str]) -> None:
    """Config and prompts of a run beside its results."""
    folder = Path(folder)
    (folder / "prompts").mkdir(parents=True, exist_ok=True)
    (folder / "config.json").write_text(json.dumps(plain(config), indent=2), encoding="utf-8")
    for name, text in prompts.items():
        (folder / "prompts" / re.sub(r"[^\w.-]", "_", name)).write_text(text, encoding="utf-8")
