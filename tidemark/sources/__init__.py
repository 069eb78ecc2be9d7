"""Readers and writers."""

import codecs
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the raw files, as they are published, by ours. Fixed values.
PUBLISHED = {
    "timestamp": "# Timestamp", "mobile_type": "Type of mobile", "mmsi": "MMSI", "lat": "Latitude", "lon": "Longitude", "nav_status": "Navigational status", "rot": "ROT", "sog": "SOG", "cog": "COG",
    "heading": "Heading", "imo": "IMO", "callsign": "Callsign", "name": "Name", "ship_type": "Ship type", "cargo_type": "Cargo type", "width": "Width", "length": "Length",
    "pos_fix_type": "Type of position fixing device", "draught": "Draught", "destination": "Destination", "eta": "ETA", "data_source": "Data source type", "a": "A", "b": "B", "c": "C", "d": "D",
}
REQUIRED = ("timestamp", "mmsi", "lat", "lon")


class Store:
    """Tables under one root, each in folders dt=<day or other name> of Parquet files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, dt: str | None = None) -> DataFrame:
        """All partitions, or the one; `dt` stays text, so days and names go together."""
        df = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}")
        if "dt" in df.columns:
            df = df.withColumn("dt", F.col("dt").cast("string"))
        return df if dt is None else df.where(F.col("dt") == dt)

    def write(self, df: DataFrame, table: str, order: tuple = (), partition: str | None = "dt") -> None:
        """Replaces the partitions that `df` has, or the whole table, when all tasks are done. A
        reader of a partition that is just then replaced may miss its files and has to read again.
        `order` clusters rows within files."""
        out = (df.sortWithinPartitions(*order) if order else df).write.mode("overwrite").option("compression", "zstd")
        if partition:
            out = out.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
        out.parquet(f"{self.root}/{table}")

    def days(self, table: str) -> DataFrame:
        return self.read(table).select("dt").distinct()


def _words(name: str) -> list:
    """Words of a column name: letters and digits in lower case, spelled the British way."""
    return [re.sub("aft$", "aught", w) for w in re.findall("[a-z0-9]+", name.lower())]


def _close(name: list, published: list) -> bool:
    """Whether a name abbreviates a published one: run together they are the same, or each of its
    words, but ship, vessel and size, begins a different word of it."""
    if "".join(name) == "".join(published):
        return True
    left = list(published)
    for w in [w for w in name if w not in ("ship", "vessel", "size")] or name:
        fit = next((p for p in left if p == w or len(w) > 2 and p.startswith(w)), None)
        if fit is None:
            return False
        left.remove(fit)
    return True


def header_map(header: list) -> dict:
    """{our name: position} of a raw file's header: of each published name the column that has it,
    else the first that abbreviates it and no other one. Raises where a required one is missing."""
    names = [_words(h) for h in header]
    published = {n: _words(p) for n, p in PUBLISHED.items()}
    at = {n: names.index(p) for n, p in published.items() if p in names}
    for i, h in enumerate(names):
        if h and i not in at.values():
            near = [n for n, p in published.items() if _close(h, p) or h == n.split("_")]
            if len(near) == 1:
                at.setdefault(near[0], i)
    if missing := [n for n in REQUIRED if n not in at]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return at


def drift(header: list) -> tuple[list, list]:
    """(columns of a header that are none of ours, published names that it lacks)."""
    at = header_map(header)
    return [h for i, h in enumerate(header) if i not in at.values()], [p for n, p in PUBLISHED.items() if n not in at]


def sniff(sample: bytes):
    """(encoding, delimiter) of a raw file's beginning. The encoding is UTF-8 if a decoder that may
    still wait for bytes takes the sample. The delimiter is the sign that the most lines have as
    often as the first one does; of equal ones the one that is there more often."""
    try:
        text, encoding = codecs.getincrementaldecoder("utf-8-sig")().decode(sample), "utf-8-sig"
    except UnicodeDecodeError:
        text, encoding = sample.decode("latin-1"), "latin-1"
    lines = text.splitlines()[:20]
    lines = lines[:-1] or lines  # the last one may be cut
    first = lines[0] if lines else ""
    agree = {d: (sum(x.count(d) == first.count(d) for x in lines), first.count(d)) for d in ",;\t|" if d in first}
    return encoding, max(agree, key=agree.get, default=",")


def read_zipped_csv(spark: SparkSession, paths, chunk: int = 50_000) -> DataFrame:
    """All csv members of zip archives as string columns under our names, with `file` and `bad`:
    a malformed line is a row without values and bad = 1, so that counts of them add up. A zip can't
    be split, so each is one task, and at most 2 GB, as the row of a file; its members are read as
    streams, `chunk` rows at a time."""
    names = list(PUBLISHED)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.lower().endswith((".csv", ".txt")):
                            continue
                        with z.open(member) as head:
                            encoding, sep = sniff(head.read(64_000))
                        lines = csv.reader(io.TextIOWrapper(z.open(member), encoding=encoding, errors="replace", newline=""), delimiter=sep)
                        head = next(lines, [])
                        at, rows = header_map(head), []
                        frame = lambda rows: pd.DataFrame(rows, columns=[*names, "bad"], dtype=object).assign(file=path)  # noqa: B023, E731
                        for line in lines:
                            whole = len(line) == len(head)
                            if line:
                                rows.append([line[at[n]] if whole and n in at else None for n in names] + [int(not whole)])
                            if len(rows) >= chunk:
                                yield frame(rows)
                                rows = []
                        if rows:
                            yield frame(rows)

    schema = ", ".join(f"{n} string" for n in names) + ", bad bigint, file string"
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def read_csv(spark: SparkSession, path, columns: list | None = None, null: str = "-0-", **options) -> DataFrame:
    """Headerless csv with given column names, or a csv with a header; `null` stands for null."""
    reader = spark.read.options(nullValue=null, mode="PERMISSIVE", **options)
    return reader.csv(path, schema=", ".join(f"`{c}` string" for c in columns)) if columns else reader.option("header", True).csv(path)


def read_parties(spark: SparkSession, path: str) -> DataFrame:
    """(party, profile, date, name) of XML parties and their dated entry events."""
    parties = spark.read.format("xml").option("rowTag", "DistinctParty").schema("_FixedRef string, Profile struct<_ID:string>, Name string").load(path)
    entries = spark.read.format("xml").option("rowTag", "SanctionsEntry").schema("_ProfileID string, EntryEvent array<struct<Date:struct<Year:int,Month:int,Day:int>>>").load(path)
    dated = entries.select("_ProfileID", F.explode("EntryEvent").alias("e")).select("_ProfileID", F.expr("try_make_timestamp(e.Date.Year, e.Date.Month, e.Date.Day, 0, 0, 0)").cast("date").alias("date"))
    return parties.join(dated, F.col("_FixedRef") == F.col("_ProfileID")).select(F.col("_FixedRef").alias("party"), F.col("Name").alias("name"), "date")


def read_entities(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Vessels (id, number, name) and actions (entity, program, date, url) of JSON lines."""
    rows = spark.read.schema("id string, schema string, properties map<string,array<string>>").json(path)
    p = lambda n: F.col("properties")[n]
    vessels = rows.where("schema = 'Vessel'").select("id", F.explode_outer(p("imoNumber")).alias("n"), F.get(p("name"), F.lit(0)).alias("name"))
    vessels = vessels.select("id", F.regexp_replace("n", r"\D", "").try_cast("bigint").alias("number"), "name")
    actions = rows.where("schema = 'Sanction'").select(F.explode(p("entity")).alias("entity"), F.get(p("programId"), F.lit(0)).alias("program"), F.try_to_date(F.get(p("startDate"), F.lit(0)), "yyyy-MM-dd").alias("date"), F.get(p("sourceUrl"), F.lit(0)).alias("url"))
    return vessels, actions


def read_events(spark: SparkSession, path) -> DataFrame:
    """Nested event JSON as flat rows, one for each event id."""
    schema = "id string, type string, start string, end string, position struct<lat:double,lon:double>, vessel struct<id:string,ssvid:string>, gap struct<durationHours:double,distanceKm:double>, encounter struct<vessel:struct<id:string,ssvid:string>>, port_visit struct<startAnchorage:struct<name:string,flag:string>>, loitering struct<totalTimeHours:double>"
    e = spark.read.schema(schema).json(path)
    t = lambda c: F.try_to_timestamp(F.regexp_replace(c, "Z$", "")).cast("timestamp_ntz")
    flat = e.select(
        F.col("id").alias("event_id"), "type", t("start").alias("start"), t("end").alias("observed_at"), "position.lat", "position.lon", F.col("vessel.id").alias("vessel_id"), F.col("vessel.ssvid").try_cast("bigint").alias("mmsi"),
        F.col("gap.durationHours").alias("gap_hours"), F.col("gap.distanceKm").alias("gap_km"), F.col("encounter.vessel.id").alias("partner_id"), F.col("encounter.vessel.ssvid").try_cast("bigint").alias("partner_mmsi"),
        F.col("port_visit.startAnchorage.name").alias("port"), F.col("port_visit.startAnchorage.flag").alias("port_country"), F.col("loitering.totalTimeHours").alias("loitering_hours"),
    )
    return flat.dropDuplicates(["event_id"])


_DAY = re.compile(r"^\s*[•\-*]?\s*(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b")
_HEAD = re.compile(r"(?i)\b(added|removed|changed|amended|deleted)\b")
_ACTION = {"added": "add", "removed": "remove", "deleted": "remove", "changed": "modify", "amended": "modify"}
_NUMBER = re.compile(r"(?i)\bIMO\s*(\d{7})\b")


def parse_changes(text: str):
    """(date, action, number, entry) of a text of dated changes: a line with a date sets the date,
    a heading the action, and an entry runs over lines until the next one, a blank line or a
    heading. `X -to- Y` of one entry is a change of X whatever the heading."""
    date, action, entry, out = None, None, [], []

    def flush():
        whole = " ".join(entry)
        entry.clear()
        if whole and date:
            kind = "modify" if "-to-" in whole else action
            for n in dict.fromkeys(_NUMBER.findall(whole)):
                if kind:
                    out.append((date, kind, int(n), whole))

    for line in text.splitlines():
        if m := _DAY.match(line):
            flush()
            month, day, year = (int(x) for x in m.groups())
            date = f"{year:04d}-{month:02d}-{day:02d}" if month <= 12 and day <= 31 else date
            line = line[m.end() :]
        if (m := _HEAD.search(line)) and line.rstrip().endswith(":"):
            flush()
            action = _ACTION[m[1].lower()]
        elif not line.strip():
            if not (entry and entry[-1].endswith("-to-")):
                flush()
        else:
            entry.append(line.strip())
            if line.rstrip().endswith((".", ";")):
                flush()
    flush()
    return out


def read_changes(spark: SparkSession, paths) -> DataFrame:
    """Rows of parse_changes() of each text file: the state runs through a file, so a file is one
    row of input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *r) for p, t in zip(f["path"], f["text"]) for r in parse_changes(t)]
            yield pd.DataFrame(rows, columns=["path", "date", "action", "number", "entry"])

    text = spark.read.format("binaryFile").load(paths).select("path", F.decode("content", F.lit("UTF-8")).alias("text"))
    return text.mapInPandas(run, "path string, date string, action string, number bigint, entry string").withColumn("date", F.to_date("date"))


def write_bundle(df: DataFrame, path: str, name: str) -> None:
    """One JSON document a row, split by column `name`."""
    df.select(name, F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").partitionBy(name).text(path)
