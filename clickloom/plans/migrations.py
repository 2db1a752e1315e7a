"""Schema migrations with a ledger table."""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..schema import VERSIONS
from ..sources.published import files_below, read_text

LEDGER = "version int, description string, applied_at timestamp, applied_by string, checksum string, rollback_sql string"
FILE, BACK = re.compile(r"V(\d+)__((?:(?!\.rollback\.sql$).)+)\.sql$"), ".rollback.sql"


@dataclass(frozen=True)
class Migration:
    version: int
    description: str
    sql: str
    rollback: str | None = None

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.sql.encode()).hexdigest()[:16]

    @classmethod
    def from_file(cls, name: str, sql: str, rollback: str | None = None) -> "Migration":
        m = FILE.search(name)
        if not m:
            raise ValueError(f"not a migration: {name}")
        return cls(int(m[1]), m[2].replace("_", " "), sql, rollback)


def from_folder(spark: SparkSession, folder: str) -> list[Migration]:
    """The migrations of a folder: V001__name.sql, with V001__name.rollback.sql beside it where there is a way back. Two of one version are an error."""
    names = [name for name, _ in files_below(spark, folder) if "/" not in name]
    found = []
    for name in names:
        if FILE.search(name):
            back = name.removesuffix(".sql") + BACK
            found.append(Migration.from_file(name, read_text(spark, f"{folder}/{name}"), read_text(spark, f"{folder}/{back}") if back in names else None))
    versions = [m.version for m in found]
    if len(set(versions)) < len(versions):
        raise ValueError(f"several migrations of one version: {sorted(versions)}")
    return sorted(found, key=lambda m: m.version)


class Migrations:
    """Applies migrations in order and records them in a Parquet ledger. Statements run through spark.sql."""

    def __init__(self, spark: SparkSession, ledger: str, known: list[Migration], by: str = "clickloom"):
        self.spark, self.path, self.by = spark, ledger, by
        self.known = {m.version: m for m in sorted(known, key=lambda m: m.version)}

    def ledger(self) -> DataFrame:
        """Applied migrations: the last entry of each version, unless that took it back."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], LEDGER)
        rows = self.spark.read.parquet(self.path)
        last = rows.groupBy("version").agg(F.max_by(F.struct(*rows.columns), F.struct("entry")).alias("r")).select("r.*").filter("not undone")
        return last.select(*[c.split()[0] for c in LEDGER.split(", ")])

    def current(self) -> int:
        return self.ledger().agg(F.max("version")).first()[0] or 0

    def pending(self) -> list[Migration]:
        done = {r["version"] for r in self.ledger().select("version").collect()}  # a row for each version of the schema
        return [m for v, m in self.known.items() if v not in done]

    def _record(self, m: Migration, undone: bool) -> None:
        now = dt.datetime.now()
        row = (m.version, m.description, now, self.by, m.checksum, m.rollback, undone, now.timestamp())
        self.spark.createDataFrame([row], LEDGER + ", undone boolean, entry double").write.mode("append").parquet(self.path)

    def apply(self, version: int) -> bool:
        """False if it is applied already; an error unless it is the next version."""
        if version not in {m.version for m in self.pending()}:
            return False
        if version != self.current() + 1:
            raise ValueError(f"version {version} cannot follow {self.current()}")
        m = self.known[version]
        for statement in filter(str.strip, m.sql.split(";")):
            self.spark.sql(statement)
        self._record(m, undone=False)
        return True

    def changed(self) -> list[int]:
        """Applied versions whose file is another one now."""
        done = {r["version"]: r["checksum"] for r in self.ledger().select("version", "checksum").collect()}
        return [v for v, m in self.known.items() if v in done and done[v] != m.checksum]

    def plan(self, target: int | None = None) -> list[tuple[str, Migration]]:
        """The steps to a version (the newest, if none is given) in order: `apply` upwards, or `roll back` downwards. Nothing is run.

        A changed file, a gap and a step down without a way back are errors.
        """
        if self.changed():
            raise ValueError(f"files of applied versions have changed: {self.changed()}")
        now = self.current()
        target = max([now, *self.known]) if target is None else target
        if target and target not in self.known:
            raise ValueError(f"no version {target}")
        if target >= now:
            steps = [("apply", m) for v, m in self.known.items() if now < v <= target]
            if [m.version for _, m in steps] != list(range(now + 1, target + 1)):
                raise ValueError(f"versions are missing between {now} and {target}")
            return steps
        ways = {r["version"]: r["rollback_sql"] for r in self.ledger().select("version", "rollback_sql").collect()}
        down = sorted((v for v in ways if v > target), reverse=True)
        if stuck := [v for v in down if not ways[v] or v not in self.known]:
            raise ValueError(f"no way back from {stuck}")
        return [("roll back", self.known[v]) for v in down]

    def go(self, target: int | None = None) -> list[tuple[str, int]]:
        """Take the steps of `plan`; each is in the ledger when it is done, so that a failure leaves a known version."""
        done = []
        for step, m in self.plan(target):
            self.apply(m.version) if step == "apply" else self.roll_back(m.version)
            done.append((step, m.version))
        return done

    def apply_all(self) -> list[int]:
        return [m.version for m in self.pending() if self.apply(m.version)]

    def roll_back(self, version: int) -> None:
        found = self.ledger().filter(F.col("version") == version).collect()
        if not found or not found[0]["rollback_sql"]:
            raise ValueError(f"version {version} is not applied or has no way back")
        for statement in filter(str.strip, found[0]["rollback_sql"].split(";")):
            self.spark.sql(statement)
        self._record(self.known[version], undone=True)

    def history(self) -> DataFrame:
        """The ledger with the step to the next version (more than 1: a gap) and the current one marked."""
        rows = self.ledger()  # a row for each version
        newest = F.max("version").over(W.partitionBy())
        return rows.select("version", "description", "applied_at", (F.lead("version").over(W.orderBy("version")) - F.col("version")).alias("gap"), (F.col("version") == newest).alias("is_current"))


def column_inventory(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Every known column with its version, and whether a table has it."""
    have = dict(df.dtypes)
    return spark.createDataFrame([(v, n, t.simpleString(), n in have) for v, columns in VERSIONS.items() for n, t in columns], "version int, column string, type string, present boolean")
