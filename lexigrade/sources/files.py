"""Source files, path rules, dictionaries, labelled comments, settings and weights."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexigrade.functions import lexicons as L

# --- fixed values -----------------------------------------------------------------------

EXCLUDED_FOLDERS = "node_modules bower_components vendor dist out build target coverage .git .venv venv __pycache__".split()
LANGUAGE_BY_EXTENSION = (
    dict.fromkeys("ts mts cts".split(), "typescript")
    | {"tsx": "typescriptreact"}
    | dict.fromkeys("js mjs cjs".split(), "javascript")
    | {"jsx": "javascriptreact", "py": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c"}
    | dict.fromkeys("cpp cc cxx hpp".split(), "cpp")
    | {"cs": "csharp", "rb": "ruby", "php": "php", "sh": "shellscript", "bash": "shellscript", "css": "css"}
)
LABELS = ["easy", "ok", "hard"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def language_for_path(path: Column) -> Column:
    """Language of the last extension, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair)), extension(path))


def is_scanned(path: Column, excluded: list[str] | None = None) -> Column:
    """A known extension, and no excluded folder above the file."""
    folders = F.split(path, "/")
    above = F.slice(folders, F.lit(1), F.size(folders) - 1)
    banned = F.array(*(F.lit(e) for e in (EXCLUDED_FOLDERS if excluded is None else excluded)))
    return language_for_path(path).isNotNull() & ~F.arrays_overlap(above, banned)


def is_within(path: Column, root: str) -> Column:
    return (path == root) | F.startswith(path, F.lit(root.rstrip("/") + "/"))


def include_under(folder: str) -> str:
    """A glob of the scanned files below a folder whose own name is taken literally."""
    literal = "".join(f"[{c}]" if c in "*?[]{}" else c for c in folder)
    return f"{literal}/**/*.{{{','.join(LANGUAGE_BY_EXTENSION)}}}"


def scan(spark: SparkSession, root: str, *, most: int | None = L.MAX_FILES, max_bytes: int = L.MAX_FILE_BYTES) -> DataFrame:
    """(path, language_id, text) of the files below root that are scanned.

    Names are filtered while listing and sizes before contents are read.  ``most`` is the
    file limit of a workspace; None for a corpus.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inside = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    found = found.where(is_scanned(inside) & (F.col("length") <= max_bytes))
    found = found if most is None else found.orderBy("path").limit(most)
    return found.select("path", language_for_path(F.col("path")).alias("language_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def load_zipf(spark: SparkSession, path: str) -> DataFrame:
    """(word, zipf) of a JSON object {word: frequency}."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,double>")).alias("word", "zipf"))
    return pairs


def labeled_comments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of labelled comments; an unknown label fails and names its line."""
    schema = "id int, repo string, commit string, path string, line int, languageId string, kind string, text string, label string"
    rows = spark.read.schema(schema).json(path)
    good = F.col("label").isin(LABELS)
    return rows.withColumn("label", F.when(good, F.col("label")).otherwise(F.raise_error(F.concat(F.lit("Comment "), F.col("id").cast("string"), F.lit(": unknown label "), F.coalesce("label", F.lit("null"))))))


def write_weights(path: str, weights: dict, bands: dict) -> None:
    """Weights and bands as pretty JSON, in scoring order (a file of the driver)."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"weights": weights, "bands": bands}, file, indent=2)
        file.write("\n")


@dataclass(frozen=True)
class Settings:
    """What a user may set; a bad value falls back to the default."""

    enabled: bool = True
    languages: tuple[str, ...] = ()
    threshold: float = 0.0
    show_only_above: bool = False
    diagnostics: bool = False
    weights: dict = field(default_factory=dict)
    acronyms: tuple[str, ...] = ()
    ramp_start: float = L.RAMP_START
    ramp_end: float = L.RAMP_END

    @staticmethod
    def parse(values: dict) -> "Settings":
        out = Settings()
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        for name in ("enabled", "show_only_above", "diagnostics"):
            if isinstance(values.get(name), bool):
                out = replace(out, **{name: values[name]})
        if isinstance(values.get("languages"), (list, tuple)):
            out = replace(out, languages=tuple(v for v in values["languages"] if isinstance(v, str)))
        if isinstance(values.get("acronyms"), (list, tuple)):
            spelt = (v.strip().lower() for v in values["acronyms"] if isinstance(v, str))
            out = replace(out, acronyms=tuple(dict.fromkeys(v for v in spelt if re.fullmatch("[a-z0-9]+", v))))
        if number(values.get("threshold")) and 0 <= values["threshold"] <= 10:
            out = replace(out, threshold=float(values["threshold"]))
        start, end = values.get("ramp_start"), values.get("ramp_end")
        if number(start) and number(end) and 0 <= start < end:
            out = replace(out, ramp_start=float(start), ramp_end=float(end))
        known = {w[0] for w in L.WEIGHTS}
        given = values.get("weights")
        if isinstance(given, dict):
            out = replace(out, weights={k: float(v) for k, v in given.items() if k in known and number(v) and v >= 0})
        return out

    def fitted(self) -> list[tuple]:
        return [(m, self.weights.get(m, w), easy, hard, ramped) for m, w, _, easy, hard, ramped in L.WEIGHTS]

    def keeps(self, language: Column) -> Column:
        return F.lit(self.enabled) & (F.lit(True) if not self.languages else language.isin(list(self.languages)))
