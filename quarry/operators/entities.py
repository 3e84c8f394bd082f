"""Named things in text: dates, technologies, projects, capitalised runs and given literals, in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Names of technologies, by groups.
TECHNOLOGIES = [
    "Rust", "Python", "Go", "JavaScript", "TypeScript", "Java", "Ruby", "Swift", "Kotlin", "Scala", "Haskell", "Erlang", "Elixir", "Clojure", "Lua", "Perl", "PHP", "R", "Julia", "Dart", "Zig",
    "C++", "C#", "C", "React", "Vue", "Angular", "Svelte", "Next.js", "Nuxt", "Remix", "Django", "Flask", "FastAPI", "Express", "Rails", "Spring", "Laravel", "Actix", "Axum", "Rocket", "Warp",
    "Redis", "PostgreSQL", "MySQL", "MongoDB", "SQLite", "DynamoDB", "Cassandra", "Elasticsearch", "Neo4j", "InfluxDB", "CockroachDB", "MariaDB", "Oracle", "MSSQL",
    "Docker", "Kubernetes", "Git", "AWS", "GCP", "Azure", "Terraform", "Ansible", "Helm", "Grafana", "Prometheus", "Kafka", "RabbitMQ", "Nginx", "Apache", "Linux", "macOS", "Windows", "HDF5",
    "GraphQL", "gRPC", "REST", "WebSocket", "OAuth", "JWT", "WASM", "WebAssembly", "CUDA", "OpenGL", "Vulkan",
]
# Words about days, names of months, last words of organisations and places, words that start no name.
RELATIVE_DATES = ["yesterday", "today", "tomorrow", "last week", "next week", "this week", "last month", "next month", "this month", "last year", "next year", "this year", "recently", "soon"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ORGANISATIONS = ["Inc", "Corp", "LLC", "Ltd", "Systems", "Technologies", "Labs", "Solutions", "Group", "Co", "Foundation", "Institute", "Association"]
LOCATIONS = ["City", "State", "County", "Province", "Island", "Mountain", "River", "Lake", "Bay", "Valley", "Park", "Street", "Avenue", "Boulevard"]
STOP_WORDS = ["The", "A", "An", "In", "On", "At", "To", "For", "Of", "And", "Or", "But", "Is", "Are", "Was", "Were", "It", "This", "That", "These", "Those", "He", "She", "They", "We", "I", "My", "His", "Her", "Its", "Our"]

_ISO = r"\d{4}[-/]\d{2}[-/]\d{2}"
_MONTH = "(?:" + "|".join(sorted(MONTHS, key=len, reverse=True)) + ")"
_DATE = re.compile(rf"(?<!\w)(?:{_ISO}|{_MONTH}\.? \d{{1,2}}(?:, \d{{4}})?|\d{{1,2}} {_MONTH}(?: \d{{4}})?|{'|'.join(RELATIVE_DATES)})(?!\w)", re.IGNORECASE)
_TECHNOLOGY = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(TECHNOLOGIES, key=len, reverse=True)) + r")(?![A-Za-z0-9])")
_CAMEL = re.compile(r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]{4})(?=(?:[A-Z0-9_]*[a-z]){2})[A-Z][A-Za-z0-9_]*[A-Z][A-Za-z0-9_]*")
_KEBAB = re.compile(r"(?<![A-Za-z0-9-])[a-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)+(?![A-Za-z0-9-])")
_CAPITALS = re.compile(r"(?<!^)(?<![.!?] )(?<![.!?\n])\b[A-Z]\w+(?: [A-Z]\w+){0,2}")


def extract(text: str, least: float = 0.5, custom: tuple[tuple[str, str, float], ...] = ()) -> list[tuple[str, str, int, int, float]]:
    """(text, kind, start, end, confidence): spans in order; of spans that overlap, the one that starts first stays, then the surer one."""
    found = [(m.group(), "date", *m.span(), 0.95) for m in _DATE.finditer(text)]
    found += [(m.group(), "technology", *m.span(), 0.9) for m in _TECHNOLOGY.finditer(text)]
    found += [(m.group(), "project", *m.span(), 0.7) for p in (_CAMEL, _KEBAB) for m in p.finditer(text)]
    for m in _CAPITALS.finditer(text):
        words = m.group().split()
        start = m.start()
        while words and words[0] in STOP_WORDS:
            start += len(words.pop(0)) + 1
        if words:
            kind = "organisation" if words[-1] in ORGANISATIONS else "location" if words[-1] in LOCATIONS else "person"
            found.append((" ".join(words), kind, start, start + len(" ".join(words)), 0.6))
    for literal, kind, confidence in custom:
        found += [(m.group(), kind, *m.span(), confidence) for m in re.finditer(re.escape(literal), text)]
    out: list[tuple[str, str, int, int, float]] = []
    for e in sorted((e for e in found if e[4] >= least), key=lambda e: (e[2], -e[4], -e[3], e[1])):
        if not out or e[2] >= out[-1][3]:
            out.append(e)
    return out


def extracted(rows: DataFrame, least: float = 0.5, custom: tuple[tuple[str, str, float], ...] = ()) -> DataFrame:
    """id, text, kind, start, end, confidence of each entity in rows (id, text)."""

    def task(batches):
        for batch in batches:
            out = [(i, *e) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in extract(t or "", least, custom)]
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "text", "kind", "start", "end", "confidence"])

    return rows.select(F.col("id").cast("long"), "text").mapInArrow(task, "id long, text string, kind string, start int, end int, confidence double")


def distinct_entities(found: DataFrame) -> DataFrame:
    """The first of each (text without case, kind)."""
    by = Window.partitionBy(F.lower("text"), "kind").orderBy("id", "start")
    return found.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")
