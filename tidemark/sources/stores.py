"""Sinks and stores: the keyed call store, network artifacts, configuration, lists and report sections."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.history import entity_hash, strip


class CallStore:
    """A memo of calls as a parquet table by task; a key is answered once.

    ``put`` appends only keys not yet stored (anti join), so running a job twice changes nothing. The
    table is never rewritten; writers that race may store a key twice, and ``read`` takes the earliest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:  # the first run has no table yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        order = F.struct("created_utc", F.coalesce("response", F.lit("")))
        return rows.groupBy("key").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "key"]), order).alias("r")).select("key", "r.*")

    def missing(self, wanted: DataFrame) -> DataFrame:
        rows = self.read()
        distinct = wanted.filter("key is not null").dropDuplicates(["key"])
        return distinct if rows is None else distinct.join(rows.select("key"), "key", "left_anti")

    def lookup(self, task: str | None = None, account: str | None = None, prefix: str | None = None) -> DataFrame | None:
        """Stored calls of a task, of an account, or whose ``trait`` begins with ``prefix``."""
        rows = self.read()
        if rows is None:
            return None
        if task is not None:
            rows = rows.filter(F.col("task") == task)
        if account is not None:
            rows = rows.filter(F.col("account_hash") == account)
        return rows.filter(F.col("trait").startswith(prefix)) if prefix is not None else rows

    def put(self, rows: DataFrame) -> None:
        self.missing(rows).write.mode("append").partitionBy("task").parquet(self.path)

    def answer(self, wanted: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Stored answers for ``wanted``; what is missing is scored once, stored, and joined back."""
        self.put(score(self.missing(wanted)))
        rows = self.read()
        return wanted.join(rows.select("key", "response"), "key", "left")


def scored(calls: DataFrame, generate: Callable[[str, int], str], valid: Callable[[str], bool], retries: int = 1, nudge: str = "", strict: bool = False) -> DataFrame:
    """Responses of a backend, asked again up to ``retries`` times while invalid.

    ``generate(request, attempt)`` runs in the workers, batch by batch; from the second attempt on ``nudge``
    is put behind the request. A call that stays invalid gets a null response, or with ``strict`` fails
    the job. Adds ``response`` and ``attempts``.
    """
    names = calls.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + ", response string, attempts int"

    def run(batches):
        for pdf in batches:
            answers, tries = [], []
            for request in pdf["request"]:
                for attempt in range(retries + 1):
                    text = generate(request + nudge if attempt else request, attempt)
                    if valid(text):
                        break
                else:
                    if strict:
                        raise ValueError(f"no valid response after {retries + 1} attempts: {str(text)[:200]!r}")
                    text = None
                answers.append(text)
                tries.append(attempt + 1)
            yield pdf[names].assign(response=answers, attempts=tries)

    return calls.mapInPandas(run, schema)


#: What each kind of table is partitioned by. Accounts are dealt to buckets, so that files stay few.
SINKS = {"items": ["bucket"], "chunks": ["bucket"], "index": [], "deviations": ["bucket"], "matrices": ["bucket"], "recovery": []}


def save_table(df: DataFrame, path: str, kind: str, buckets: int = 64) -> None:
    """A table of the study, replaced as a whole; rows of an account lie in one bucket, those of a heavy
    one in as many files as tasks wrote them."""
    by = SINKS[kind]
    rows = df.withColumn("bucket", F.pmod(F.xxhash64("account_hash"), F.lit(buckets)).cast("int")) if by else df
    (rows.write.partitionBy(*by) if by else rows.write).mode("overwrite").parquet(f"{path}/{kind}")


def load_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{kind}")
    return rows.drop("bucket") if SINKS[kind] else rows


def save_edges(edges: DataFrame, path: str, estimator: str, config_hash: str) -> None:
    """Edge artifacts, partitioned by estimator and configuration, replaced as a whole."""
    edges.write.mode("overwrite").parquet(f"{path}/estimator={estimator}/config_hash={config_hash}")


def load_edges(spark: SparkSession, path: str, estimator: str, config_hash: str | None = None) -> DataFrame:
    """The artifacts of one configuration; without a hash there must be exactly one."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/estimator={estimator}")
    if config_hash is None:
        found = [r[0] for r in rows.select("config_hash").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} configurations of {estimator}; name one")
        config_hash = found[0]
    return rows.filter(F.col("config_hash") == config_hash)


def unbuilt(accounts: DataFrame, spark: SparkSession, path: str, estimator: str, config_hash: str) -> DataFrame:
    """F8: the accounts without an artifact of this estimator and configuration."""
    try:
        built = load_edges(spark, path, estimator, config_hash).select("account_hash").distinct()
    except AnalysisException:  # nothing has been built yet
        return accounts
    return accounts.join(built, "account_hash", "left_anti")


def save_sidecar(spark: SparkSession, path: str, facts: dict) -> None:
    """Facts about an artifact beside it, as one line of JSON, on whatever file system ``path`` names."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def leaves(document: dict) -> dict[tuple, object]:
    """The values of a nested document by their paths; lists and empty dictionaries are values."""
    found, todo = {}, [((), document)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, dict) and (node or not path):
            todo += [((*path, str(k)), v) for k, v in node.items()]
        else:
            found[path] = node
    return found


def overlaid(base: dict[tuple, object], over: dict[tuple, object]) -> dict[tuple, object]:
    """``over`` laid over ``base``, path by path; a value displaces all that lay above or below it."""
    out = dict(base)
    for path, value in over.items():
        below = [p for p in out if len(p) > len(path) and p[: len(path)] == path]
        if value == {} and below:
            continue
        for p in [*below, *(path[:n] for n in range(1, len(path)) if path[:n] in out)]:
            del out[p]
        out[path] = value
    return out


class Config:
    """Settings by dotted path, later files over earlier ones, with a content hash."""

    def __init__(self, data: dict | None = None, flat: dict[tuple, object] | None = None):
        self.flat = leaves(data or {}) if flat is None else flat

    @classmethod
    def load(cls, *paths: str) -> "Config":
        import yaml

        flat: dict[tuple, object] = {}
        for p in paths:
            flat = overlaid(flat, leaves(yaml.safe_load(Path(p).read_text(encoding="utf-8")) or {}))
        return cls(flat=flat)

    def get(self, dotted: str, default=None):
        """The value at a path, or the part of the document below it."""
        want = tuple(dotted.split("."))
        if want in self.flat:
            return self.flat[want]
        part: dict = {}
        for path, value in sorted(self.flat.items()):
            if path[: len(want)] == want:
                at = part
                for key in path[len(want) : -1]:
                    at = at.setdefault(key, {})
                at[path[-1]] = value
        return part or default

    def hash(self, *leave_out: str, inline: dict | None = None) -> str:
        """Eight hex digits over all settings but those below ``leave_out``; ``inline`` (a vocabulary, say) counts too."""
        rows = sorted((".".join(p), v) for p, v in self.flat.items() if p[0] not in leave_out)
        text = json.dumps([rows, sorted((".".join(p), v) for p, v in leaves(inline or {}).items())], sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()[:8]


VOCABULARY = "trait_idx int, name string, valence string, domain string, sign string, likableness double, antonym string"


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary from YAML (``traits``: a list of entries), its order kept.

    Names must be unique, antonyms mutual and the valences equally many.
    """
    import yaml

    entries = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("traits", [])
    mates = {e["name"]: e.get("antonym") for e in entries}
    if len(mates) != len(entries):
        raise ValueError("names must be unique")
    if any(mates.get(m) != n for n, m in mates.items()):
        raise ValueError("antonyms must be mutual")
    valences = [e.get("valence") for e in entries]
    if valences.count("pos") != valences.count("neg"):
        raise ValueError("valences must be equally many")
    rows = [(i, e["name"], e.get("valence"), e.get("domain"), e.get("sign"), None if e.get("likableness") is None else float(e["likableness"]), e.get("antonym")) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, VOCABULARY)


def load_exclusions(path: str) -> tuple[list[str], list[str]]:
    """The exact and the prefix list of forums to leave out, in lower case, each name once."""
    import yaml

    lists = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return tuple(sorted({str(x).strip().lower() for x in lists.get(part) or []}) for part in ("exact", "prefix"))


class NameMap:
    """Raw names by hash, kept apart from all other tables and never joined to them.

    The folder must lie below one that version control ignores: some folder above it holds a ``.gitignore``
    with the name of one of the folders between.
    """

    def __init__(self, spark: SparkSession, path: str, salt: str):
        inside = Path(path).resolve()
        ignored = any(
            (up / ".gitignore").is_file() and {line.strip().strip("/") for line in (up / ".gitignore").read_text().splitlines()} & set(inside.relative_to(up).parts)
            for up in inside.parents
        )
        if not ignored:
            raise PermissionError(f"{path} is not ignored by version control")
        self.spark, self.path, self.salt = spark, path, salt

    def add(self, names: DataFrame, column: str) -> DataFrame:
        """Stores the names not yet known and returns the distinct hashes."""
        rows = names.select(entity_hash(F.col(column), self.salt).alias("account_hash"), F.lower(strip(F.col(column))).alias("name")).filter("account_hash is not null").distinct()
        old = self.read()
        (rows if old is None else rows.join(old.select("account_hash"), "account_hash", "left_anti")).write.mode("append").parquet(self.path)
        return rows.select("account_hash")

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None


def names_from(lines: Iterable[str]) -> list[str]:
    """Names from comma lists and lines with ``#`` comments, each once, in order."""
    out: dict[str, None] = {}
    for line in lines:
        for name in line.split("#", 1)[0].split(","):
            if name.strip():
                out.setdefault(name.strip())
    return list(out)


def seeded_names(by_forum: dict[str, list[str]], sample: int) -> list[str]:
    """Names met in several forums, at most an equal share from each (rounded up), each once, in order."""
    share = -(-sample // max(1, len(by_forum)))
    return list(dict.fromkeys(n for names in by_forum.values() for n in names[:share]))[:sample]


def table_section(df: DataFrame, most: int = 200) -> str:
    """An aggregate of at most ``most`` rows as a Markdown table, in the order of its columns."""
    rows = df.orderBy(*df.columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds aggregates of at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.3f}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def write_section(path: str, name: str, body: str) -> None:
    """A report on the driver's disk with the section of this name replaced, or appended."""
    file = Path(path)
    file.write_text(splice(file.read_text(encoding="utf-8") if file.is_file() else "", name, body), encoding="utf-8")


def splice(document: str, name: str, body: str) -> str:
    """The document with the block between the markers of ``name`` replaced or appended."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    block = f"{begin}\n{body.rstrip()}\n{end}"
    pattern = re.compile(re.escape(begin) + r".*?" + re.escape(end), re.S)
    if pattern.search(document):
        return pattern.sub(lambda _: block, document, count=1)
    return (document.rstrip() + "\n\n" if document.strip() else "") + block + "\n"
