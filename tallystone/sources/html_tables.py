"""Tables in HTML pages: key rates, and dividends of two layouts. Rows are (page_id, html) in, one row for each table row out.

A page is tokenised once, in one expression: the marks that begin tables, rows and cells become one character each, all other markup goes, and what is
left is split by them. A mark needs no end, so unclosed rows and cells are read as well.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystone.functions.finance import amount, first_date
from tallystone.sources.dataset import Datasets

#: Words of the pages' headers (fixed values of the sources).
REGISTER_CLOSE, DIVIDEND, CUT_OFF, LAST_BUY, FORECAST = "закрытия реестра", "дивиденд", "дата отсечки", "t-1", "прогноз"
#: Tickers under which a security's history goes on (fixed values of the sources).
ALIASES = {"TCSG": "T", "YNDX": "YDEX", "FIVE": "X5", "MAIL": "VKCO", "LNTA": "LENT"}
#: Characters that stand for the begin of a table, its end, and the begin of a row and of a cell, by the tag.
TABLE, END, ROW, CELL = "\x01", "\x02", "\x03", "\x04"
MARKS = {r"<table\b[^>]*>": TABLE, r"</table\s*>": END, r"<tr\b[^>]*>": ROW, r"<t[dh]\b[^>]*>": CELL}
#: Character references that these pages use, the ampersand's last (fixed values of the standard).
REFERENCES = {"&nbsp;": " ", "&#160;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _marked(html: str) -> Column:
    """The page as text between marks."""
    marks = reduce(lambda c, mark: F.regexp_replace(c, "(?i)" + mark[0], mark[1]), MARKS.items(), F.coalesce(F.col(html), F.lit("")))
    plain = F.regexp_replace(marks, r"<[^>]*>", "")
    return reduce(lambda c, ref: F.replace(c, F.lit(ref[0]), F.lit(ref[1])), REFERENCES.items(), plain)


def _after(text: Column, mark: str) -> Column:
    """What stands after each mark, up to the next."""
    parts = F.split(text, mark)
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def _cells(text: Column) -> Column:
    return F.transform(_after(text, CELL), lambda c: F.regexp_replace(F.regexp_replace(c, f"[{TABLE}{END}{ROW}]", " "), r"^\s+|\s+$", ""))


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, table_no, cells): each table as an array of rows, each an array of plain cell texts."""
    tables = pages.select("page_id", F.posexplode(_after(_marked(html), TABLE)).alias("table_no", "table"))
    inside = F.element_at(F.split("table", END), 1)
    return tables.select("page_id", "table_no", F.transform(_after(inside, ROW), _cells).alias("cells"))


def key_rates(pages: DataFrame, html: str = "html") -> DataFrame:
    """(date, rate_pct) of cells that hold a day, each followed by a cell that holds a number; of equal dates one."""
    listed = pages.select(_cells(_marked(html)).alias("cell"))
    pairs = listed.select(F.explode(F.arrays_zip(F.col("cell").alias("day"), F.expr("slice(cell, 2, size(cell))").alias("number"))).alias("p"))
    days = pairs.where(F.col("p.day").rlike(r"^\d{2}\.\d{2}\.\d{4}$") & F.col("p.number").rlike(r"^\d[\d,]*$"))
    rows = days.select(F.to_date("p.day", "dd.MM.yyyy").alias("date"), F.translate("p.number", ",", ".").cast("double").alias("rate_pct"))
    return rows.groupBy("date").agg(F.min("rate_pct").alias("rate_pct"))


def cached_key_rates(store: Datasets, first: str, last: str, fetch: Callable[[str, str], DataFrame]) -> DataFrame:
    """Key rates of a span of days through a store of datasets: pages are fetched (first, last) and read once for each span."""
    return store.cached(f"key_rates/{first}_{last}", lambda: key_rates(fetch(first, last)))


def _dividends(pages: DataFrame, record: str, source: str) -> DataFrame:
    """(page_id, record_date, amount, last_day_with_rights, source) of tables that have a row which names the record date.

    That row, the first if there are several, tells what a column holds; each later row is read by these roles. A row that is marked as a forecast anywhere, and one whose
    date or amount is missing or can't be read, gives nothing.
    """

    def role(name: Column) -> Column:
        name = F.lower(name)
        return F.when(name.contains(record), "record").when(name.startswith(DIVIDEND), "amount").when(name.contains(LAST_BUY), "rights")

    rows = table_cells(pages).select("page_id", "table_no", F.posexplode("cells").alias("row_no", "row"))
    roles = rows.select("page_id", "table_no", "row_no", F.transform("row", role).alias("roles")).where(F.array_contains("roles", "record"))
    heads = roles.groupBy("page_id", "table_no").agg(F.min_by("roles", "row_no").alias("roles"), F.min("row_no").alias("head"))
    body = rows.join(heads, ["page_id", "table_no"]).where(F.col("row_no") > F.col("head"))
    body = body.where(~F.exists("row", lambda c: F.lower(c).contains(FORECAST))).withColumn("named", F.arrays_zip("roles", "row"))
    held = lambda name: F.get(F.filter("named", lambda x: x["roles"] == name), F.lit(0))["row"]
    found = body.select(
        "page_id", first_date(held("record")).alias("record_date"), amount(held("amount")).alias("amount"), first_date(held("rights")).alias("last_day_with_rights"), F.lit(source).alias("source")
    )
    return found.where("record_date is not null and amount is not null")


def register_dividends(pages: DataFrame, source: str = "register") -> DataFrame:
    """Dividends of tables with a column for the day on which the register is closed."""
    return _dividends(pages, REGISTER_CLOSE, source)


def cutoff_dividends(pages: DataFrame, source: str = "cut-off") -> DataFrame:
    """Dividends of tables with a column for the cut-off day, and one for the last day to buy if they have it."""
    return _dividends(pages, CUT_OFF, source)


def dividend_history(first: DataFrame, second: DataFrame, pages: DataFrame) -> DataFrame:
    """The first source's dividends of each ticker where it has any, else the second's; pages (page_id, secid) say whose they are, aliases count as their old ticker.
    Equal (record_date, amount) of a ticker once."""
    old = F.create_map(*[F.lit(x) for new_old in ((v, k) for k, v in ALIASES.items()) for x in new_old])
    owner = pages.select("page_id", F.coalesce(old[F.upper("secid")], F.upper("secid")).alias("secid"))
    a, b = first.join(owner, "page_id"), second.join(owner, "page_id")
    both = a.unionByName(b.join(a.select("secid").distinct(), "secid", "left_anti"))
    return both.groupBy("secid", "record_date", "amount").agg(F.min("last_day_with_rights").alias("last_day_with_rights"), F.min("source").alias("source"))
