"""Search planning (A5-A14): form rows -> expanded terms x locations = the search grid.

Each rule is one column expression on the search's own row. The single-rule frames (A5-A10)
explode those expressions, and the planner puts the same ones together, so planning needs
no shuffle besides attaching the replies, and thousands of searches plan in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.functions.text import py_strip

# --- fixed values (must equal the reference) --------------------------------
FORM_DEFAULTS = {
    "term": "Engenheiro",
    "min_score": 80,
    "filter_words": "",
    "location": "Brazil",
    "results_wanted": 30,
    "hours_old": 24,
}
MAX_EXPANDED_TERMS = 10
MAX_TERMS = 5
MIN_RESULTS = 10
REMOTE_WORDS = ("remote", "remoto")
REMOTE_LOCATIONS = ("USA", "UK", "Ireland")
COUNTRY_ALIASES = (
    ("usa", "usa"), ("eua", "usa"), ("us", "usa"), ("united states", "usa"),
    ("uk", "uk"), ("united kingdom", "uk"),
    ("ireland", "ireland"), ("irlanda", "ireland"),
)
DEFAULT_COUNTRY = "brazil"
LEGACY_PHRASE = ("vagas de ", " em ")
# ---------------------------------------------------------------------------


def form_defaults(raw: DataFrame) -> DataFrame:
    """Fill missing form fields; a bad integer or a negative count rejects the row.

    Input columns ``*_raw`` (strings). Output typed columns plus ``form_ok``. Other columns
    (such as ``user_id``) pass through.
    """
    d = FORM_DEFAULTS

    def number(name: str) -> Column:
        given = F.col(f"{name}_raw")
        return F.when(given.isNull(), F.lit(d[name])).otherwise(given.try_cast("int")).alias(name)

    def words(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_raw"), F.lit(d[name])).alias(name)

    out = raw.select(*[c for c in raw.columns if not c.endswith("_raw")], words("term"), number("min_score"), words("filter_words"),
                     words("location"), number("results_wanted"), number("hours_old"))
    ok = F.col("min_score").isNotNull() & (F.col("results_wanted") >= 0) & (F.col("hours_old") >= 0)
    return out.withColumn("form_ok", F.coalesce(ok, F.lit(False)))


# --- one expression a rule -----------------------------------------------------

def listed_terms(reply: Column) -> Column:
    """The comma list's items, stripped; blank ones are null (positions stay)."""
    items = F.transform(F.split(F.coalesce(reply, F.lit("")), ","), py_strip)
    return F.transform(items, lambda x: F.when(x != "", x))


def expanded_terms(term: Column, reply: Column) -> Column:
    """A5: the base term, then the reply's items."""
    return F.concat(F.array(term), F.filter(listed_terms(reply), lambda x: x.isNotNull()))


def distinct_terms(items: DataFrame, array: str, name: str) -> DataFrame:
    """Adds ``name``, the first of the items that differ in case only, order kept.

    Sorted by lower case and place, the first of equals has another one before it; what
    stays is sorted back by place. The sorted array is a column of its own, since an
    expression inside a lambda is evaluated anew for every element.
    """
    keyed = F.array_sort(F.transform(array, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("item"))))
    fresh = F.filter("_sorted", lambda e, i: (i == 0) | (F.get("_sorted", i - 1)["low"] != e["low"]))
    placed = F.array_sort(F.transform(fresh, lambda e: F.struct(e["at"], e["item"])))
    return items.withColumn("_sorted", keyed).withColumn(name, F.transform(placed, lambda e: e["item"])).drop("_sorted")


def capped_terms(terms: Column) -> Column:
    """Of the items that differ in more than case the first 10, then the first 5 of those.

    One pass that keeps at most ten items, however many a reply has.
    """
    kept = F.array().cast("array<struct<low:string,item:string>>")

    def taken(found: Column, item: Column) -> Column:
        low = F.lower(item)
        return F.when((F.size(found) >= MAX_EXPANDED_TERMS) | F.exists(found, lambda e: e["low"] == low), found).otherwise(
            F.concat(found, F.array(F.struct(low.alias("low"), item.alias("item")))))

    first = F.aggregate(terms, kept, taken)
    return F.slice(F.transform(first, lambda e: e["item"]), 1, MAX_TERMS)


def quota_per_term(results_wanted: Column, n_terms: Column) -> Column:
    """max(10, results_wanted // number of terms)."""
    return F.greatest(F.lit(MIN_RESULTS), F.floor(results_wanted / n_terms).cast("int"))


def is_remote_word(location: Column) -> Column:
    return F.lower(py_strip(location)).isin(*REMOTE_WORDS)


def is_remote_search(location: Column) -> Column:
    """A10: the location is, or contains, a word for remote work."""
    low = F.lower(location)
    return is_remote_word(location) | low.contains(REMOTE_WORDS[0]) | low.contains(REMOTE_WORDS[1])


def scanned_locations(location: Column) -> Column:
    """A10: remote -> USA, UK, Ireland; else the location itself."""
    return F.when(is_remote_word(location), F.array(*[F.lit(x) for x in REMOTE_LOCATIONS])).otherwise(F.array(location))


def quota_per_location(location: Column, quota: Column) -> Column:
    """A10: max(10, quota // 3) for each of the remote locations."""
    return F.when(is_remote_word(location), F.greatest(F.lit(MIN_RESULTS), F.floor(quota / 3).cast("int"))).otherwise(quota)


def country_of(loc: Column) -> Column:
    """Exact lower-case alias match (no strip), else brazil."""
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.lower(loc)), F.lit(DEFAULT_COUNTRY))


def default_phrase(term: Column, location: Column, given: Column) -> Column:
    """The legacy search phrase when none was given."""
    return F.when(given.isNotNull() & (given != ""), given).otherwise(
        F.concat(F.lit(LEGACY_PHRASE[0]), term, F.lit(LEGACY_PHRASE[1]), location)
    )


# --- the rules as frames ---------------------------------------------------------

def parse_term_list(replies: DataFrame, text_col: str = "reply") -> DataFrame:
    """Comma list -> (search_id, pos, term), empties dropped."""
    return replies.select("search_id", F.posexplode(listed_terms(F.col(text_col))).alias("pos", "term")).where(F.col("term").isNotNull())


def with_terms(searches: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Accepted searches with ``expanded`` (A5) and ``terms`` (A7, A8) arrays."""
    ok = searches.where("form_ok")
    if replies is None:
        rows = ok.withColumn("_reply", F.lit(None).cast("string"))
    else:
        rows = ok.join(replies.select("search_id", F.col("reply").alias("_reply")), "search_id", "left")
    return rows.withColumn("expanded", expanded_terms(F.col("term"), F.col("_reply"))).withColumn("terms", capped_terms(F.col("expanded"))).drop("_reply")


def term_rows(planned: DataFrame, array: str) -> DataFrame:
    """(search_id, term_no, term) of one of the arrays of ``with_terms``."""
    return planned.select("search_id", F.posexplode(array).alias("term_no", "term"))


def with_quota(planned: DataFrame) -> DataFrame:
    """Adds ``n_terms`` and ``quota`` per term."""
    return planned.withColumn("n_terms", F.size("terms")).withColumn("quota", quota_per_term(F.col("results_wanted"), F.col("n_terms")))


def expand_locations(quotas: DataFrame) -> DataFrame:
    """A10: rows (search_id, location, quota, ...) -> one row a scanned location."""
    loc = F.col("location")
    return quotas.select("*", F.posexplode(scanned_locations(loc)).alias("loc_no", "loc")).select(
        *[c for c in quotas.columns if c not in ("location", "quota")], "loc_no", "loc",
        is_remote_search(loc).alias("remote_search"), quota_per_location(loc, F.col("quota")).alias("loc_quota"))


def resolve_country(locations: DataFrame) -> DataFrame:
    """A11 over location rows: adds ``country``."""
    return locations.withColumn("country", country_of(F.col("loc")))


def plan_searches(searches: DataFrame, replies: DataFrame | None) -> DataFrame:
    """A5-A12 end to end: searches (typed, form_ok) + expansion replies -> grid.

    A12: every term of a search with every location of it. Grid columns: search_id,
    term_no, term, loc_no, loc, remote_search, quota (per location; null where
    ``results_wanted`` is null), country, and the search's other fields.
    """
    by_location = resolve_country(expand_locations(with_quota(with_terms(searches, replies))))
    limited = F.when(F.col("results_wanted").isNotNull(), F.col("loc_quota")).alias("quota")
    rest = [c for c in searches.columns if c not in ("search_id", "term", "location", "form_ok")]
    return by_location.select("search_id", F.posexplode("terms").alias("term_no", "term"), "loc_no", "loc", "remote_search", limited, "country", *rest)
