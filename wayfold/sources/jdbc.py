"""Relational stores over JDBC: scans with pushdown, whole-query pushdown, and the three ways to write.

Trajectories travel as EWKB: binary when read, hex text when written.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zipfile
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

APPEND, OVERWRITE, REPLACE = "append", "overwrite", "replace"
_NAME = re.compile(r"^[A-Za-z_][\w$]*(\.[A-Za-z_][\w$]*)*$")


def _checked(name: str) -> str:
    if not _NAME.match(name):
        raise ValueError(f"not a table or column name: {name!r}")
    return name


def _quoted(name: str) -> str:
    """A column as the database spells it."""
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Store:
    """One database. ``options`` are Spark's JDBC options such as user, password and driver."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def _reader(self):
        return self.spark.read.format("jdbc").option("url", self.url).options(**self.options)

    def table(self, name: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        """A table or view, described by the database at once, so new ones are seen without a restart.

        Columns, filters, limits and aggregates are pushed down by Spark. partition is (column, low, high, parts)
        and reads by ranges of a number column, one connection a part.
        """
        reader = self._reader().option("dbtable", _checked(name))
        if partition:
            column, low, high, parts = partition
            reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
        return reader.load()

    def query(self, sql: str) -> DataFrame:
        """A whole query run by the database."""
        return self._reader().option("query", sql).load()

    def catalog(self, name: str) -> None:
        """All schemas of the database as catalog ``name``."""
        prefix = f"spark.sql.catalog.{name}"
        self.spark.conf.set(prefix, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
        for key, value in {"url": self.url, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true", **self.options}.items():
            self.spark.conf.set(f"{prefix}.{key}", value)

    def decoded(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """df with EWKB columns read, binary or hex text: columns maps a name to trajectory, polygon or point."""
        function = {"trajectory": "wkb_to_trajectory", "polygon": "polygon_from_wkb", "point": "point_from_wkb"}
        kinds = dict(df.dtypes)
        cell = lambda c: f"unhex(`{c}`)" if kinds[c] == "string" else f"`{c}`"
        return df.select(*[F.expr(f"{function[columns[c]]}({cell(c)})").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])

    def write(self, df: DataFrame, name: str, mode: str = APPEND, key: list[str] | None = None) -> None:
        """Writes df's rows.

        append adds them; overwrite empties the table and fills it, keeping its definition; replace updates rows of
        equal key and adds the others. A column that the table lacks is an error before anything is written.
        overwrite and replace first load a staging table, then change the target in one transaction: a lost
        executor repeats its part of the staging load only.
        """
        target = self.table(name).columns
        unknown = {c.lower() for c in df.columns} - {c.lower() for c in target}
        if unknown:
            raise ValueError(f"{name} has no column {sorted(unknown)}")
        wkb = [f.name for f in df.schema if f.dataType.simpleString().replace(" ", "") == "array<struct<x:double,y:double,m:double>>"]
        df = df.select(*[F.expr(f"hex(trajectory_to_wkb(`{c}`))").alias(c) if c in wkb else F.col(f"`{c}`") for c in df.columns])
        if mode == APPEND:
            self._load(df, _checked(name), "append")
            return
        if mode not in (OVERWRITE, REPLACE) or (mode == REPLACE and not key):
            raise ValueError(f"mode {mode!r} with key {key!r}")
        own = {c.lower(): c for c in target}
        if mode == OVERWRITE and self._refill(df, _checked(name)):
            return
        staging = f"{_checked(name)}_{uuid.uuid4().hex[:12]}"
        try:
            into = ", ".join(_quoted(own[c.lower()]) for c in df.columns)
            self._stage(df, staging, name, into)
            staged = {c.lower(): c for c in self.table(staging).columns}
            columns = ", ".join(_quoted(staged[c.lower()]) for c in df.columns)
            match = " AND ".join(f"{name}.{_quoted(own[k.lower()])} = {staging}.{_quoted(staged[k.lower()])}" for k in key or [])
            if mode == REPLACE:  # without it, rows of equal key are looked for in the whole staging table, once for each row
                self.execute([f"CREATE INDEX K_{uuid.uuid4().hex[:12]} ON {staging} ({', '.join(_quoted(staged[k.lower()]) for k in key)})"], missing=True)
            clear = f"DELETE FROM {name}" + (f" WHERE EXISTS (SELECT 1 FROM {staging} WHERE {match})" if mode == REPLACE else "")
            self.execute([clear, f"INSERT INTO {name} ({into}) SELECT {columns} FROM {staging}"])
        finally:
            self.execute([f"DROP TABLE {staging}"], missing=True)

    def _refill(self, df: DataFrame, name: str) -> bool:
        """Empties the table and fills it in one transaction without staging, where the database can; whether it did."""
        return False

    def _stage(self, df: DataFrame, staging: str, name: str, columns: str) -> None:
        """df's rows in a new table; Derby gives it the target's types, since it reads texts as CLOBs row by row."""
        if self.url.startswith("jdbc:derby:"):
            self.execute([f"CREATE TABLE {staging} AS SELECT {columns} FROM {name} WITH NO DATA"])
            self._load(df, staging, "append")
        else:
            self._load(df, staging, "overwrite")

    def _load(self, df: DataFrame, table: str, how: str) -> None:
        df.write.format("jdbc").option("url", self.url).options(**self.options).option("dbtable", table).mode(how).save()

    def execute(self, statements: list[str], missing: bool = False) -> None:
        """Statements in one transaction, from the driver. With ``missing`` a failure, such as a table that isn't there, is no error."""
        jvm = self.spark.sparkContext._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            if k in ("user", "password"):
                properties.setProperty(k, v)
        if "driver" in self.options:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            for s in statements:
                statement.execute(s)
            connection.commit()
        except Exception:
            connection.rollback()
            if not missing:
                raise
        finally:
            connection.close()


def _local(path: str) -> str:
    """A shared folder's path as the database's files need it."""
    scheme = urlparse(path).scheme
    if scheme not in ("", "file"):
        raise ValueError(f"an embedded database needs a folder of a file system, not {path!r}")
    return urlparse(path).path if scheme else path


@dataclass
class Embedded(Store):
    """A Derby database in ``folder``, which the driver and all executors share. One process at a time may change such a database, any number may read a packed one.

    So the driver has it while it is written: executors write rows as CSV files beside it, which the database imports
    in bulk. ``published`` then packs it, for scans with pushdown from every executor.
    """

    folder: str = ""

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Embedded:
        home = _local(folder)
        os.makedirs(home)
        made = cls(spark, f"jdbc:derby:{home}/db", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}, folder)
        made._connect(";create=true")
        return made

    def _connect(self, attributes: str, ends: bool = False) -> None:
        """Opens the database with these attributes; with ``ends`` that closes it, which Derby tells by an error."""
        jvm = self.spark.sparkContext._jvm
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.options["driver"])
        try:
            jvm.java.sql.DriverManager.getConnection(self.url + attributes).close()
        except Exception as e:
            if not (ends and "08006" in str(e.java_exception.getSQLState())):
                raise

    def _load(self, df: DataFrame, table: str, how: str) -> None:
        """Imports df's rows, added or instead of the table's own (how is append or replace): one file, so one transaction. Instead of others they aren't logged, and indexes are built in one go."""
        part = f"rows-{uuid.uuid4().hex}"
        quoting = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
        at = f"{_local(self.folder)}/{part}"
        try:
            df.write.options(**quoting).csv(f"{self.folder}/{part}")
            own = {c.lower(): c for c in self.table(table).columns}
            names = ",".join(own[c.lower()] for c in df.columns)
            schema, _, plain = table.rpartition(".")
            text = lambda s: "'" + s.replace("'", "''") + "'"
            with open(f"{at}/all", "wb") as out:
                for f in sorted(f for f in os.listdir(at) if f.endswith(".csv")):
                    with open(f"{at}/{f}", "rb") as rows:
                        shutil.copyfileobj(rows, out, 1 << 20)
                    os.remove(f"{at}/{f}")
                empty = not out.tell()
            if not empty:
                self.execute([f"CALL SYSCS_UTIL.SYSCS_IMPORT_DATA({text(schema.upper()) if schema else 'NULL'}, {text(plain.upper())}, {text(names)}, NULL, {text(f'{at}/all')}, ',', '\"', 'UTF-8', {int(how == 'replace')})"])
            elif how == "replace":
                self.execute([f"DELETE FROM {table}"])
        finally:
            shutil.rmtree(at, ignore_errors=True)

    def _refill(self, df: DataFrame, name: str) -> bool:
        self._load(df, name, "replace")
        return True

    def _stage(self, df: DataFrame, staging: str, name: str, columns: str) -> None:
        self.execute([f"CREATE TABLE {staging} AS SELECT {columns} FROM {name} WITH NO DATA"])
        self._load(df, staging, "replace")

    def published(self) -> Store:
        """The database as it is, closed and packed into one file that every executor reads."""
        self._connect(";shutdown=true", ends=True)
        home = _local(self.folder)
        packed = f"{home}/packed-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED, allowZip64=True) as out:
            for folder, _, files in os.walk(f"{home}/db"):
                for f in files:
                    if not f.endswith(".lck"):
                        out.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), home))
        return Store(self.spark, f"jdbc:derby:jar:({packed})db", self.options)
