"""Filters and predicates (D1-D12) over posting rows.

Rows carry their search parameters as columns (``term_norm``, ``tokens``, ``words``),
so one program evaluates many searches; for a single search the parameters are
literals that Catalyst folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.functions import text as T

# --- fixed values (legacy intake rules; must equal the reference) ------------
ROLE_MODIFIERS = ("relacionamento", "contas", "faturamento", "auditoria", "venda", "promoção", "auxiliar de", "assistente de")
DEGREE_WORDS = ("superior", "graduacao", "formacao", "bacharelado")
BENEFIT_WORDS = ("convenio", "plano", "assistencia", "seguro")
DEGREE_SPAN = 50
BENEFIT_SPAN = 20
# ---------------------------------------------------------------------------


def with_search_terms(df: DataFrame, term: Column | str, filter_words: Column | str | None = None) -> DataFrame:
    """Attach per-row search parameters: term_norm (C1), tokens (C4), words."""
    term_c = F.lit(term) if isinstance(term, str) else term
    fw = F.lit(filter_words or "") if (filter_words is None or isinstance(filter_words, str)) else filter_words
    return (
        df.withColumn("term_norm", T.normalize_text(term_c))
        .withColumn("tokens", T.term_tokens(F.col("term_norm")))
        .withColumn("words", T.required_words(fw))
    )


def with_norms(df: DataFrame) -> DataFrame:
    """Normalised title/company/description, link and fingerprint."""
    return (
        df.withColumn("title_norm", T.normalize_text("title"))
        .withColumn("company_norm", T.normalize_text("company"))
        .withColumn("desc_norm", T.normalize_text("description"))
        .withColumn("link", F.col("job_url"))
        .withColumn("fingerprint", T.fingerprint("title_norm", "company_norm"))
    )


def valid_posting(title: Column | str = "title", link: Column | str = "job_url") -> Column:
    """Title and link present (null or empty -> invalid)."""
    t = F.col(title) if isinstance(title, str) else title
    lk = F.col(link) if isinstance(link, str) else link
    return t.isNotNull() & (t != "") & lk.isNotNull() & (lk != "")


def _missing_words(words: Column, title_norm: Column, desc_norm: Column) -> Column:
    return F.filter(words, lambda w: ~title_norm.contains(w) & ~desc_norm.contains(w))


def required_keywords(words: Column, title_norm: Column, desc_norm: Column) -> Column:
    """Every required word is a substring of the normalised title or description."""
    return F.forall(words, lambda w: title_norm.contains(w) | desc_norm.contains(w))


def first_missing_keyword(words: Column, title_norm: Column, desc_norm: Column) -> Column:
    """D3: the first required word that fails (null when all are present)."""
    return F.try_element_at(_missing_words(words, title_norm, desc_norm), F.lit(1))


def title_any_token(title_norm: Column, tokens: Column) -> Column:
    """D4."""
    return T.title_any_token(title_norm, tokens)


def desc_whole_phrase(desc_norm: Column, term_norm: Column) -> Column:
    """D5."""
    return T.whole_phrase(desc_norm, term_norm)


def relevance(title_norm: Column, desc_norm: Column, tokens: Column, term_norm: Column) -> Column:
    """Title token hit or whole phrase in the description."""
    return title_any_token(title_norm, tokens) | desc_whole_phrase(desc_norm, term_norm)


def annotate(df: DataFrame) -> DataFrame:
    """Every flag the intake loop tests, per row (expects with_norms + with_search_terms)."""
    tn, dn = F.col("title_norm"), F.col("desc_norm")
    return (
        df.withColumn("valid", valid_posting())
        .withColumn("missing_word", first_missing_keyword(F.col("words"), tn, dn))
        .withColumn("in_title", title_any_token(tn, F.col("tokens")))
        .withColumn("in_desc", desc_whole_phrase(dn, F.col("term_norm")))
        .withColumn("relevant", F.col("in_title") | F.col("in_desc"))
        .withColumn("candidate", F.col("valid") & F.col("missing_word").isNull() & F.col("relevant"))
    )


def score_threshold(score: Column, min_score: Column) -> Column:
    """A truthy score at or above the threshold (0 and null never pass)."""
    return F.coalesce(score.isNotNull() & (score != 0) & (score >= min_score), F.lit(False))


def recency(posted_at: Column, hours_old: Column, as_of: str) -> Column:
    """Posted within ``hours_old`` hours before ``as_of`` (null hours: no limit)."""
    limit = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(as_of))) - hours_old.cast("long") * 3600)
    return hours_old.isNull() | (posted_at >= limit)


# --- legacy rules (D7-D10): regexes on legacy-normalised text --------------------

def _regex_quote(c: Column) -> Column:
    """Escape regex metacharacters of a column value (the reference leaves them raw)."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def role_modifier_exclusion(title_norm: Column, term_norm: Column, modifiers=ROLE_MODIFIERS) -> Column:
    """The title holds a role modifier, white space of any script, then the term."""
    pattern = F.concat(F.lit("(" + "|".join(modifiers) + f")[{T.SPACE}]+"), _regex_quote(term_norm))
    return F.regexp_like(title_norm, pattern)


def degree_proximity(desc_norm: Column, term_norm: Column, words=DEGREE_WORDS, span: int = DEGREE_SPAN) -> Column:
    """A degree word, at most ``span`` characters (no newline), then the term."""
    pattern = F.concat(F.lit("(" + "|".join(words) + ")[^\\n]{0," + str(span) + "}"), _regex_quote(term_norm))
    return F.regexp_like(desc_norm, pattern)


def benefit_proximity(desc_norm: Column, term_norm: Column, words=BENEFIT_WORDS, span: int = BENEFIT_SPAN) -> Column:
    """A benefit word, at most ``span`` characters, then the term (flag only)."""
    pattern = F.concat(F.lit("(" + "|".join(words) + ")[^\\n]{0," + str(span) + "}"), _regex_quote(term_norm))
    return F.regexp_like(desc_norm, pattern)


def legacy_approval(title_norm: Column, term_norm: Column, modifier: Column, degree: Column, benefit: Column) -> Column:
    """Not excluded and (term in title or degree proximity).

    The benefit rule only sets false what is already false, so ``benefit`` cannot
    change the result; it is accepted to keep the reference's signature and the
    tests prove it is inert.
    """
    del benefit  # can only clear an approval that is already false
    return ~modifier & (title_norm.contains(term_norm) | degree)
