"""Which archive file has which day: listings, the map from days to files, and the bulk run."""

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ARCHIVE = r"\.(?i:zip|rar|7z|gz)$"


def listed(pages: DataFrame, text: str = "text") -> DataFrame:
    """(name, link, kind, start, end) of the archives that pages of a directory, or of an object
    store's listing, name: a day, a month, or an unknown kind without dates. Each name once."""
    links = F.concat(F.regexp_extract_all(F.col(text), F.lit(r"(?i)href\s*=\s*[\x22']([^\x22']+)[\x22']"), F.lit(1)), F.regexp_extract_all(F.col(text), F.lit(r"<Key>([^<]+)</Key>"), F.lit(1)))
    rows = pages.select(F.explode(links).alias("link")).withColumn("name", F.element_at(F.split(F.regexp_replace("link", "/+$", ""), "/"), -1))
    rows = rows.where(F.col("name").rlike(_ARCHIVE)).dropDuplicates(["name"])
    day = F.try_to_date(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})(?=\.\w+$)", 1), "yyyy-MM-dd")
    month = F.try_to_date(F.concat(F.regexp_extract("name", r"(?<!\d-)(?<!\d)(\d{4}-\d{2})(?=\.\w+$)", 1), F.lit("-01")), "yyyy-MM-dd")
    start = F.coalesce(day, month)
    kind = F.when(day.isNotNull(), "daily").when(month.isNotNull(), "monthly").otherwise("unknown")
    return rows.select("name", "link", kind.alias("kind"), start.alias("start"), F.when(day.isNotNull(), day).otherwise(F.last_day(month)).alias("end"))


def next_page(text: str) -> str | None:
    """The token that an object store's listing goes on from."""
    m = re.search(r"<NextContinuationToken>([^<]+)</NextContinuationToken>", text)
    return m[1] if m else None


def pages_of(fetch, start: str) -> list:
    """All pages of a listing: fetch(place, token) gives a page's text."""
    out, token = [], None
    while True:
        out.append(fetch(start, token))
        token = next_page(out[-1])
        if not token:
            return out


def first_of(places: list, load):
    """What load(place) gives for the first place that has it; all errors if none does."""
    errors = []
    for place in places:
        try:
            return load(place)
        except OSError as e:
            errors.append(f"{place}: {e}")
    raise OSError("; ".join(errors))


def files_for_days(files: DataFrame, first: str, last: str) -> DataFrame:
    """(day, name, link, kind): of the files that have a day, a daily one goes before a monthly one."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    some = files.where((F.col("kind") != "unknown") & (F.col("end") >= lo) & (F.col("start") <= hi))
    days = some.withColumn("day", F.explode(F.sequence(F.greatest("start", lo), F.least("end", hi))))
    order = Window.partitionBy("day").orderBy(F.col("kind") != "daily", "name")
    return days.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("day", "name", "link", "kind")


def bulk_run(days: DataFrame, done: DataFrame, work, stop: int = 3) -> dict:
    """work(link, days) for each file that has days which aren't done yet, by its first day; ends
    after `stop` failures one after the other. Days are marked by work itself, so that a rerun goes
    on. The list has a row for each file, so it is short."""
    pending = days.join(done.select("day"), "day", "left_anti").groupBy("link").agg(F.array_sort(F.collect_list("day")).alias("days")).orderBy(F.col("days")[0], "link").collect()
    out, row = {"done": 0, "failed": []}, 0
    for r in pending:
        try:
            work(r["link"], r["days"])
            out["done"] += len(r["days"])
            row = 0
        except Exception as e:  # noqa: BLE001 - any failure of one file is reported, not raised
            out["failed"].append((r["link"], str(e)))
            row += 1
            if row >= stop:
                break
    return out


def window_start(earliest: date, latest: date, day_bytes: float, free_bytes: float, reserve_bytes: float, peak_bytes: float, *, safety: float = 1.2, least_months: int = 12, short: bool = False) -> date:
    """The first day whose history up to `latest` fits the disk; raises where nothing fits, or where
    less than `least_months` would, unless `short`."""
    budget = free_bytes - reserve_bytes - peak_bytes
    if budget <= 0:
        raise ValueError("no disk is left for the window")
    fit = min(int(budget / (day_bytes * safety)), (latest - earliest).days + 1)
    start = latest - timedelta(days=fit - 1)
    months = (latest.year - start.year) * 12 + latest.month - start.month
    if months < least_months and not short:
        raise ValueError(f"the window would have {months} months")
    return start
