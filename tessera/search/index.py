"""Vector indexes: cells around centres, searched from the nearest cell on, with an exact order at the end.

A partitioned index takes the place of a graph, which one machine would have to hold: cells are folders of a
Parquet table, so a search reads few of them, and building is one pass. ``ef_search`` is how many candidates a
search looks at, as there.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.vectors import DISTANCES

# Operator classes, options and their bounds.
OPERATORS = {"vector_l2_ops": "<->", "vector_ip_ops": "<#>", "vector_cosine_ops": "<=>", "vector_l1_ops": "<+>"}
M, M_LEAST, M_MOST = 16, 2, 100
EF_CONSTRUCTION, EF_LEAST, EF_MOST = 64, 4, 1000
EF_SEARCH = 40
MOST_DIMENSIONS = 2000
REBUILD_TOMBSTONES = 0.2
#: Tables of so many rows are scanned.
EXACT_ROWS = 2000
#: Rows that the centres are found from, picked by a hash of the id.
SAMPLE_ROWS = 20_000
#: Cells are as many as the root of the rows, up to this many; all centres are sent to every task.
MOST_CELLS = 4096
#: A search reads cells until they hold this many times the candidates asked for.
SLACK = 32

_CREATE = re.compile(r"(?is)create\s+index\s+(?:(?P<name>\w+)\s+)?on\s+(?P<table>\w+)\s+using\s+hnsw\s*\(\s*(?P<column>\w+)\s+(?P<ops>\w+)\s*\)(?:\s*with\s*\((?P<options>[^)]*)\))?\s*;?\s*")


@dataclass(frozen=True)
class IndexDefinition:
    """``CREATE INDEX [name] ON table USING hnsw (column opclass) [WITH (m = .., ef_construction = ..)]``."""

    name: str
    table: str
    column: str
    opclass: str = "vector_l2_ops"
    m: int = M
    ef_construction: int = EF_CONSTRUCTION

    def __post_init__(self):
        if self.opclass not in OPERATORS:
            raise ValueError(f"operator class {self.opclass} does not exist")
        if not M_LEAST <= self.m <= M_MOST:
            raise ValueError(f'value {self.m} out of bounds for option "m" ({M_LEAST}..{M_MOST})')
        if not EF_LEAST <= self.ef_construction <= EF_MOST:
            raise ValueError(f'value {self.ef_construction} out of bounds for option "ef_construction" ({EF_LEAST}..{EF_MOST})')
        if self.ef_construction < 2 * self.m:
            raise ValueError("ef_construction must be greater than or equal to 2 * m")

    @classmethod
    def parse(cls, sql: str) -> IndexDefinition:
        if not (m := _CREATE.fullmatch(sql.strip())):
            raise ValueError("not a CREATE INDEX USING hnsw")
        options = dict(re.findall(r"(\w+)\s*=\s*(\d+)", m["options"] or ""))
        if unknown := set(options) - {"m", "ef_construction"}:
            raise ValueError(f"unrecognized parameter {sorted(unknown)[0]}")
        return cls(m["name"] or f"{m['table']}_{m['column']}_idx", m["table"], m["column"], m["ops"].lower(), **{k: int(v) for k, v in options.items()})

    @property
    def operator(self) -> str:
        return OPERATORS[self.opclass]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centres_of(sample: np.ndarray, cells: int, rounds: int, seed: int = 1) -> np.ndarray:
    """Centres by Lloyd's rounds from rows drawn at random."""
    rng = np.random.default_rng(seed)
    now = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = ((now * now).sum(1)[None, :] - 2 * sample @ now.T).argmin(1)
        total = np.zeros_like(now)
        np.add.at(total, near, sample)
        n = np.bincount(near, minlength=len(now))[:, None]
        now = np.where(n > 0, total / np.maximum(n, 1), now)
    return now


class VectorIndex:
    """An index of a table's vectors in a folder: ``cells`` by cell, ``centres``, and a manifest that names the current ones.

    Rows without a vector aren't in it. Deleted rows stay as tombstones until they are a fifth of all.
    """

    def __init__(self, spark: SparkSession, definition: IndexDefinition, path: str, id_col: str = "id"):
        self.spark, self.definition, self.path, self.id_col = spark, definition, path, id_col

    # Building.

    def _rows(self, df: DataFrame) -> DataFrame:
        v = F.col(self.definition.column)
        return df.where(v.isNotNull()).select(F.col(self.id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def _fingerprint(self, rows: DataFrame) -> tuple[int, int]:
        one = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("id", "v"))).first()
        return one[0], one[1] or 0

    def build(self, df: DataFrame) -> None:
        """Every row goes to the cell of the nearest of the centres, which are found from a bounded sample; one pass, no shuffle but the writing's."""
        rows = self._rows(df)
        count, mark = self._fingerprint(rows)
        first = rows.select(F.size("v")).first()
        if first and first[0] > MOST_DIMENSIONS:
            raise ValueError(f"column cannot have more than {MOST_DIMENSIONS} dimensions for hnsw index")
        share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, count))
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("id").limit(SAMPLE_ROWS).select("v").collect()
        sample = np.array([r.v for r in some], np.float64).reshape(len(some), first[0] if first else 0)
        sample = _unit(sample) if self.definition.operator == "<=>" else sample
        cells = max(1, min(MOST_CELLS, int(count**0.5)))
        centres = centres_of(sample, cells, 4 + self.definition.ef_construction // 16) if len(sample) else np.empty((0, 0))
        folder = uuid.uuid4().hex
        self._assigned(rows, centres).write.partitionBy("cell").parquet(f"{self.path}/{folder}/cells")
        self._finish(folder, centres, count, mark)

    def _assigned(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        sent, unit = self.spark.sparkContext.broadcast(centres.astype(np.float32)), self.definition.operator == "<=>"

        @F.pandas_udf("int")
        def cell(v):
            c = sent.value
            x = np.stack(v.to_numpy()).astype(np.float32) if len(v) else np.empty((0, c.shape[1]), np.float32)
            x = _unit(x) if unit else x
            import pandas as pd

            return pd.Series(((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1).astype(np.int32))

        return rows.withColumn("cell", cell("v"))

    def _finish(self, folder: str, centres: np.ndarray, count: int, mark: int) -> None:
        """Snapshot: centres with a checksum over the cells, then the manifest, whose newest row counts."""
        cells = self.spark.read.parquet(f"{self.path}/{folder}/cells") if count else self.spark.createDataFrame([], "id long, v array<double>, cell int")
        sizes = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS
        self.spark.createDataFrame([(i, c.tolist(), sizes.get(i, 0)) for i, c in enumerate(centres)], "cell int, centre array<double>, n long").coalesce(1).write.parquet(f"{self.path}/{folder}/centres")
        row = (folder, count, mark, self._checksum(folder) if count else 0, self._generation() + 1)
        self.spark.createDataFrame([row], "folder string, n long, mark long, checksum long, generation long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _checksum(self, folder: str) -> int:
        return self.spark.read.parquet(f"{self.path}/{folder}/cells").agg(F.bit_xor(F.xxhash64("id", "v", "cell"))).first()[0] or 0

    def _manifest(self):
        try:
            return self.spark.read.parquet(f"{self.path}/manifest").orderBy(F.desc("generation")).first()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def _generation(self) -> int:
        now = self._manifest()
        return now.generation if now else 0

    def verify(self) -> bool:
        """Whether the snapshot is what its checksum says."""
        now = self._manifest()
        return now is not None and (not now.n or self._checksum(now.folder) == now.checksum)

    def reconcile(self, df: DataFrame) -> str:
        """Brings the index up to the table: ``current``, ``added`` rows in the cells there, or ``rebuilt``.

        New and changed rows go to the cells there are; once what the table no longer has is over a fifth of
        the index, or the snapshot is damaged, it is built anew.
        """
        now, rows = self._manifest(), self._rows(df)
        if now is None or not self.verify():
            self.build(df)
            return "rebuilt"
        if self._fingerprint(rows) == (now.n, now.mark):
            return "current"
        held = self.spark.read.parquet(f"{self.path}/{now.folder}/cells") if now.n else None
        dead = held.select("id", "v").exceptAll(rows).count() if held is not None else 1
        if held is None or dead > REBUILD_TOMBSTONES * held.count():
            self.build(df)
            return "rebuilt"
        centres = np.array([r.centre for r in self.spark.read.parquet(f"{self.path}/{now.folder}/centres").orderBy("cell").collect()])
        fresh = rows.exceptAll(held.select("id", "v"))
        kept = held.join(rows.withColumnRenamed("v", "now"), "id").where("v = now").select("id", "v", "cell")
        folder, (count, mark) = uuid.uuid4().hex, self._fingerprint(rows)
        kept.unionByName(self._assigned(fresh, centres)).write.partitionBy("cell").parquet(f"{self.path}/{folder}/cells")
        self._finish(folder, centres, count, mark)
        return "added"

    # Searching.

    def search(self, query: list[float], k: int, ef_search: int = EF_SEARCH) -> DataFrame:
        """``(id, dist)`` of about the ``k`` nearest rows, in exact order: all of a small table are compared, else the cells nearest to the query."""
        now, op = self._manifest(), self.definition.operator
        if now is None or not now.n:
            return self.spark.createDataFrame([], "id long, dist double")
        cells = self.spark.read.parquet(f"{self.path}/{now.folder}/cells")
        if now.n > max(ef_search, EXACT_ROWS):
            centres = self.spark.read.parquet(f"{self.path}/{now.folder}/centres").collect()  # at most MOST_CELLS
            q, wanted, have = np.array(query), [], 0
            q = q / max(np.linalg.norm(q), 1e-12) if op == "<=>" else q
            far = {"<#>": lambda c: -(q @ c), "<+>": lambda c: np.abs(q - c).sum()}.get(op, lambda c: ((q - c) ** 2).sum())
            for r in sorted(centres, key=lambda r: far(np.array(r.centre))):
                if have >= SLACK * max(k, ef_search):
                    break
                wanted.append(r.cell)
                have += r.n
            cells = cells.where(F.col("cell").isin(wanted))
        target = F.array(*[F.lit(float(x)) for x in query])
        return cells.select("id", DISTANCES[op](F.col("v"), target).alias("dist")).orderBy(F.col("dist").asc_nulls_last(), "id").limit(k)


class Runtime:
    """The indexes of a session, each brought up to its table before it answers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.indexes = spark, path, {}

    def create(self, sql: str, id_col: str = "id") -> VectorIndex:
        d = IndexDefinition.parse(sql)
        if d.name in self.indexes:
            raise ValueError(f"relation {d.name} already exists")
        self.indexes[d.name] = VectorIndex(self.spark, d, f"{self.path}/{d.name}", id_col)
        return self.indexes[d.name]

    def serving(self, table: str, column: str, operator: str) -> VectorIndex | None:
        """The index for a distance operator on a column, if there is one."""
        return next((i for i in self.indexes.values() if (i.definition.table, i.definition.column, i.definition.operator) == (table, column, operator)), None)

    def nearest(self, table: str, df: DataFrame, column: str, operator: str, query: list[float], k: int) -> DataFrame | None:
        found = self.serving(table, column, operator)
        if found is None:
            return None
        found.reconcile(df)
        return found.search(query, k)
