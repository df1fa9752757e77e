"""A snapshot of folded patches: new patches are merged into stored states, so that nothing is folded twice.

Layout under the store's folder: ``v<n>-<id>`` holds version n as Parquet in buckets of the key, ``commits/<n>`` names that folder and the last batch in it. A version is there once
its commit is; a commit is a rename that fails if another writer was first, and each writer has folders of its own. A merge joins the buckets of the last version, as they lie, with the
folded patches of one batch: only these are shuffled.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay besides the current one, for queries that read them still.
KEPT_VERSIONS = 1


class Conflict(RuntimeError):
    """Another writer committed the same version first; apply the batch again."""


def work_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; a local one only where that is unset in local mode.

    It is deleted when the application ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{top.rstrip('/')}/quillspark-store/{uuid.uuid4().hex}" if top else tempfile.mkdtemp(prefix="quillspark-store-")
    atexit.register(_leave, spark, path)
    return path


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write and read back: cuts the lineage, and lost executors cost what they were doing only."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _leave(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass(frozen=True)
class Store:
    """States of patches by ``key``: of each of ``fields`` the value of the last patch, by ``order``, that holds it.

    Patches are rows of key, order columns, fields and ``present``, an array of the field names that a patch holds. Late patches count by their place in the
    order, not by their batch. Null keys have no state.
    """

    spark: SparkSession
    path: str
    key: str
    order: tuple[str, ...]
    fields: tuple[str, ...]
    present: str = "patched"
    buckets: int = 64

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        """A path in the store's folder."""
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def commit(self) -> dict:
        """version (0 without one), batch (the last one applied, None without one) and schema."""
        fs, folder = self._fs(), self._at("commits")
        found = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
        found = [x for x in found if x.isdigit()]
        if not found:
            return {"version": 0, "batch": None, "schema": None}
        (line,) = self.spark.read.text(f"{self.path}/commits/{found[-1]}").collect()
        return json.loads(line[0])

    def _write_commit(self, commit: dict) -> None:
        fs, name = self._fs(), f"{commit['version']:09d}"
        draft = self._at("commits", f"_{name}-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(commit).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # fails if the commit is there
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(self._at("commits", name)), options)
        except Exception as e:
            fs.delete(draft, False)
            raise Conflict(f"version {commit['version']} of {self.path} was committed by another writer") from e

    def _folded(self, patches: DataFrame) -> DataFrame:
        """key, patches and of each field struct(at, value): where its last value stands in the order."""
        at = F.struct(*self.order)

        def last(f: str) -> Column:
            return F.max_by(F.struct(at.alias("at"), F.col(f).alias("value")), F.when(F.array_contains(self.present, f), at)).alias(f)

        return patches.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.count("*").alias("patches"), *map(last, self.fields))

    def _name(self, folder: str) -> str:
        return f"quillspark_{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.path}/{folder}').hex}"

    def _table(self, commit: dict) -> DataFrame:
        """The stored version, in its buckets: a table of this session that lies where the version does."""
        name = self._name(commit["folder"])
        if not self.spark.catalog.tableExists(name):
            where = f"{self.path}/{commit['folder']}".replace("'", "\\'")
            self.spark.sql(f"create table {name} ({commit['schema']}) using parquet clustered by (`{self.key}`) sorted by (`{self.key}`) into {commit['buckets']} buckets location '{where}'")
        return self.spark.table(name)

    def merged(self, patches: DataFrame) -> DataFrame:
        """States, as they are stored, after ``patches``."""
        commit, new = self.commit(), self._folded(patches)
        if not commit["version"]:
            return new
        old, key = self._table(commit).alias("old"), self.key
        both = old.join(new.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full")

        def later(f: str) -> Column:
            a, b = F.col(f"old.{f}"), F.col(f"new.{f}")
            return F.when(a.isNull() | (b["at"] > a["at"]), b).otherwise(a).alias(f)

        count = F.coalesce("old.patches", F.lit(0)) + F.coalesce("new.patches", F.lit(0))
        return both.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), count.alias("patches"), *map(later, self.fields))

    def apply(self, patches: DataFrame, batch: int) -> bool:
        """Merge a batch and commit the new version; a batch that is not after the last one is in it already, so it changes nothing and gives False.

        Fit for ``foreachBatch`` of a stream: a batch that is run again after a failure counts once.
        """
        commit = self.commit()
        if commit["batch"] is not None and batch <= commit["batch"]:
            return False
        version, states = commit["version"] + 1, self.merged(patches)
        buckets = commit.get("buckets", self.buckets)
        self._fs().mkdirs(self._at("commits"))
        folder = f"v{version:09d}-{uuid.uuid4().hex}"
        if not commit["version"]:
            states = states.repartition(buckets, self.key)
        states.write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{folder}").format("parquet").saveAsTable(self._name(folder))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in states.schema)
        self._write_commit({"version": version, "batch": batch, "folder": folder, "schema": schema, "buckets": buckets})
        self._clean(version - KEPT_VERSIONS)
        return True

    def _clean(self, first: int) -> None:
        """Delete versions before ``first``, those of writers that ended before their commit included."""
        fs = self._fs()
        for s in fs.listStatus(self._at()):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:10].isdigit() and int(name[1:10]) < first:
                self.spark.sql(f"drop table if exists {self._name(name)}")
                fs.delete(s.getPath(), True)

    def state(self) -> DataFrame:
        """key, fields and the number of patches of every key, as of the last commit."""
        commit = self.commit()
        if not commit["version"]:
            raise AnalysisException(f"nothing has been applied to {self.path}")
        return self._table(commit).select(self.key, *[F.col(f"{f}.value").alias(f) for f in self.fields], "patches")
