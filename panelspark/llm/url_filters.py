"""URL filters by temporal list join.

List entries are dated: from ``since`` on, ``pattern`` is blocked, allowed or no longer listed in
``list_name``. Each list's entries of a pattern become validity intervals, and every capture is
evaluated against the entries that were active on its day.

A pattern is a host, which covers its subdomains, or a host with its first path segment, which
covers that part of exactly this host. Of the active entries that cover a capture the longest pattern
decides; of equally long ones ``allow`` wins over ``block``, then the smaller list name.

Everything is DataFrame functions. Days bound all groups: entries of one list, pattern and day
collapse to the last action (``block`` over ``allow`` over ``remove``), and captures collapse to
distinct (host, segment, day) before the as-of join, so a host with a third of all captures brings no
more than its days and segments. The join back to captures is a plain equi-join that can be split.

Captures without a host, url or day are covered by nothing (``none``) and stay, as do repeated rows
and other columns. Entries with a null pattern, list, action or day are ignored. Empty tables work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"
ACTIONS = ("remove", "allow", "block")  # later ones win on the same day


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, pattern, action, since, until (exclusive, null: open) of every active period."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = entries.select("list_name", F.lower("pattern").alias("pattern"), F.col("since").cast("date").alias("since"), rank.alias("_rank"))
    known = known.dropna().filter("_rank > 0")
    last = known.groupBy("list_name", "pattern", "since").agg(F.max("_rank").alias("_rank"))
    order = Window.partitionBy("list_name", "pattern").orderBy("since")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("_rank").cast("int"))
    return last.select("list_name", "pattern", action.alias("action"), "since", F.lead("since").over(order).alias("until")).filter("action <> 'remove'")


def patterns(host_: Column, segment: Column) -> Column:
    """The host, its parent domains, and host/segment."""
    labels = F.split(host_, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.concat(parents, F.when(segment != "", F.array(F.concat(host_, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))))


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """``captures`` with ``decision``, ``pattern``, ``list_name`` and ``since`` of the deciding entry.

    Input columns with one of these names are left out.
    """
    rest = F.struct("*").alias("_row")
    located = captures.select(rest, F.coalesce(host(F.col(url)), F.lit("")).alias("_host"),
                              F.coalesce(F.lower(F.regexp_extract(F.col(url), SEGMENT, 1)), F.lit("")).alias("_segment"), F.col(day).cast("date").alias("_day"))
    probes = located.select("_host", "_segment", "_day").filter("_host <> '' AND _day IS NOT NULL").distinct()
    keys = probes.select("*", F.explode(patterns(F.col("_host"), F.col("_segment"))).alias("_pattern"))
    listed = intervals(entries)
    active = (F.col("_pattern") == F.col("pattern")) & (F.col("_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("_day") < F.col("until")))
    # the first of (shortest, ...) in this order is the last to decide; max takes the winner
    winner = F.min(F.struct((-F.length("pattern")).alias("_long"), "action", "list_name", "pattern", "since"))
    decided = keys.join(listed, active).groupBy("_host", "_segment", "_day").agg(winner.alias("_won"))
    joined = located.join(decided, ["_host", "_segment", "_day"], "left")
    kept = [F.col("_row")[c].alias(c) for c in captures.columns if c not in ("decision", "pattern", "list_name", "since")]
    return joined.select(*kept, F.coalesce("_won.action", F.lit("none")).alias("decision"), F.col("_won.pattern").alias("pattern"),
                         F.col("_won.list_name").alias("list_name"), F.col("_won.since").alias("since"))


def dated(pages: DataFrame) -> DataFrame:
    """Pages as captures: the day follows from the page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from the hosts, domains and first segments seen in the pages.

    A hash of the pattern says whether and when it is listed, removed and listed again.
    """
    seen = pages.select(host(F.col("url")).alias("h"), F.lower(F.regexp_extract("url", SEGMENT, 1)).alias("s")).filter("h <> ''").distinct()
    known = seen.select(F.explode(patterns(F.col("h"), F.col("s"))).alias("pattern")).filter("pattern LIKE '%.%.%'").distinct()
    h = known.select("pattern", F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long").alias("v"))

    def entry(list_name, action, start, when):
        since = F.date_add(F.lit("2024-01-01").cast("date"), start.cast("int"))
        return F.when(when, F.struct(F.lit(list_name).alias("list_name"), F.lit(action).alias("action"), since.alias("since")))

    v = F.col("v")
    made = [entry("abuse", "block", v % 300, v % 4 == 0), entry("abuse", "remove", v % 300 + 20 + v % 60, v % 4 == 0),
            entry("abuse", "block", v % 300 + 120, v % 8 == 0), entry("review", "allow", v % 170, v % 6 == 0),
            entry("review", "remove", v % 170 + 90, v % 12 == 0)]
    return h.select("pattern", F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e")).select("pattern", "e.list_name", "e.action", "e.since")


ORACLE = """
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + ((page_id * 7919) % 365)::INT AS fetched,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS h,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)) AS s FROM pages),
k AS (SELECT *, list_distinct(list_concat(
    list_transform(range(1, len(string_split(h, '.')) + 1), lambda i: array_to_string(string_split(h, '.')[i:], '.')),
    CASE WHEN s <> '' THEN [h || '/' || s] ELSE [] END)) AS ps FROM c WHERE h <> ''),
p AS (SELECT DISTINCT unnest(ps) AS pattern FROM k),
v AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS v FROM p WHERE pattern LIKE '%.%.%'),
e AS (SELECT pattern, 'abuse' AS list_name, 3 AS r, v % 300 AS d FROM v WHERE v % 4 = 0
  UNION ALL SELECT pattern, 'abuse', 1, v % 300 + 20 + v % 60 FROM v WHERE v % 4 = 0
  UNION ALL SELECT pattern, 'abuse', 3, v % 300 + 120 FROM v WHERE v % 8 = 0
  UNION ALL SELECT pattern, 'review', 2, v % 170 FROM v WHERE v % 6 = 0
  UNION ALL SELECT pattern, 'review', 1, v % 170 + 90 FROM v WHERE v % 12 = 0),
g AS (SELECT pattern, list_name, d, max(r) AS r FROM e GROUP BY ALL),
i AS (SELECT pattern, list_name, r, DATE '2024-01-01' + d::INT AS since,
  DATE '2024-01-01' + (lead(d) OVER (PARTITION BY pattern, list_name ORDER BY d))::INT AS until FROM g),
a AS (SELECT pattern, list_name, CASE r WHEN 3 THEN 'block' ELSE 'allow' END AS action, since, until FROM i WHERE r > 1),
m AS (SELECT k.page_id, a.*, row_number() OVER (PARTITION BY k.page_id ORDER BY length(a.pattern) DESC, a.action, a.list_name) AS n
  FROM k, unnest(k.ps) AS u(pattern) JOIN a ON a.pattern = u.pattern AND k.fetched >= a.since AND (a.until IS NULL OR k.fetched < a.until))
SELECT c.page_id, c.url, c.fetched, coalesce(m.action, 'none') AS decision, m.pattern, m.list_name, m.since
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.n = 1
"""
