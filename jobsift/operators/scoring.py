"""Scoring (H1-H7).

H1 re-aims the language-model score as a rubric over a skills dictionary: 40 for
hard skills, 40 for experience level, 20 for domain skills, integer 0-100.
Each text is normalised once and matched against the dictionary once. Skills and level
words given as pairs are a literal array; given as a table, of any size, they are matched by
joins of runs of words. Only the pairs a search asks for
are scored; texts are never cross-joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.functions import text as T

RUN = 3     # words of a dictionary phrase that are joined as one
HELD = 2_000_000    # skill numbers of jobs that are broadcast at once
MOST_GROUPS = 64    # of jobs, scored one after the other

# --- fixed values ------------------------------------------------------------
NO_RATIONALE = "Sem justificativa."
ERROR_RATIONALE = "Falha ao gerar avaliação devido a um erro na IA."
ABORT_MARKERS = ("429", "rate limit", "too many requests")
W_HARD, W_LEVEL, W_DOMAIN = 40, 40, 20
# Rubric rationale texts (our own wording; the reference's come from a model).
RATIONALE_HARD = "Maior lacuna: competencias tecnicas."
RATIONALE_LEVEL = "Maior lacuna: nivel de experiencia."
RATIONALE_DOMAIN = "Maior lacuna: conhecimento de dominio."
# ---------------------------------------------------------------------------

# Fixture dictionary (FIXTURES.md §4): frequent letter groups of the synthetic text.
FIXTURE_SKILLS = (
    ("that", "hard"), ("ther", "hard"), ("thou", "hard"), ("thre", "hard"), ("thor", "hard"), ("thon", "hard"),
    ("erin", "domain"), ("eron", "domain"), ("then", "domain"), ("thea", "domain"),
)
FIXTURE_LEVELS = (("tion", 1), ("erer", 2), ("than", 3))


def _dictionary(skills) -> Column:
    return F.array(*[F.named_struct(F.lit("skill"), F.lit(T.normalize_text_py(s)), F.lit("kind"), F.lit(k)) for s, k in skills])


def skills_found(text_norm: Column, skills=FIXTURE_SKILLS) -> Column:
    """array<struct<skill, kind>> of dictionary phrases present as whole words."""
    return F.filter(_dictionary(skills), lambda e: T.padded_contains(text_norm, e["skill"]))


def level_of(text_norm: Column, levels=FIXTURE_LEVELS) -> Column:
    """Highest experience level whose word is present (0 when none)."""
    lv = F.lit(0)
    for word, value in levels:
        lv = F.when(T.padded_contains(text_norm, F.lit(T.normalize_text_py(word))), F.greatest(lv, F.lit(value))).otherwise(lv)
    return lv


def text_features(text_norm: Column, skills=FIXTURE_SKILLS, levels=FIXTURE_LEVELS) -> Column:
    """struct(skills, level) of an already normalised text column.

    Pass a column produced by an earlier projection (not the normalising expression
    itself): lambda bodies are evaluated without common-subexpression elimination, so
    an inlined normalisation would run once per dictionary entry.
    """
    return F.named_struct(F.lit("skills"), skills_found(text_norm, skills), F.lit("level"), level_of(text_norm, levels))


def phrases_by_join(normed: DataFrame, id_cols: list[str], dictionary: DataFrame, value: str) -> DataFrame:
    """(ids..., skill, ``value``) of the phrases ``dictionary(skill, value)`` in the texts.

    Phrases of up to ``RUN`` words meet the texts' distinct runs of as many words in one
    equi-join, so each place of a text is one row a length, however many phrases share its
    words. A longer phrase is sought by its first ``RUN`` words, and where a text has these, the
    whole phrase is looked up in the text itself, which is read once for all its candidates.
    Texts that share a key are matched by their words' positions (``_by_positions``).
    """
    from jobsift.operators.dedup import cut_lineage
    entries = cut_lineage(dictionary.select(T.normalize_text("skill").alias("skill"), value).where("skill <> ''").distinct())
    return _matched(normed, id_cols, entries.select("skill").distinct(), ["skill"]).distinct().join(entries, "skill")


def _matched(normed: DataFrame, id_cols: list[str], entries: DataFrame, carried: list[str]) -> DataFrame:
    """(ids..., ``carried``) of the phrases ``entries(skill, carried...)``, each skill in one row, in the texts.

    No row comes twice but for keys that are null.
    """
    from jobsift.operators.dedup import cut_lineage
    many, told = cut_lineage(normed.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), {"n": F.count(F.lit(1))})
    if not told["n"]:
        return _by_runs(normed, id_cols, entries, carried)
    shared = _by_positions(normed.join(many, id_cols, "left_semi"), id_cols, entries).distinct().join(entries, "skill")
    return _by_runs(normed.join(many, id_cols, "left_anti"), id_cols, entries, carried).union(shared.select(*id_cols, *carried))


def _by_runs(normed: DataFrame, id_cols: list[str], entries: DataFrame, carried: list[str]) -> DataFrame:
    """``_matched`` for texts with a key of their own."""
    from jobsift.operators.dedup import cut_lineage
    words = F.split("skill", " ")
    length, long_ = F.least(F.size(words), F.lit(RUN)), F.size(words) > RUN
    phrases = entries.select(*carried, F.when(long_, F.col("skill")).alias("_whole"), F.array_join(F.slice(words, 1, RUN), " ").alias("_run"))
    lengths = sorted(r[0] for r in entries.select(length.alias("_length")).distinct().collect())    # RUN of them at most
    split = normed.select(*id_cols, F.split("_norm", " ").alias("_words"))
    runs = F.array_distinct(F.flatten(F.array(*[_runs(F.col("_words"), n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    met = split.select(*id_cols, F.explode(runs).alias("_run")).join(phrases, "_run")
    met = cut_lineage(met.select(*id_cols, *carried, "_whole"))
    asked = met.where("_whole is not null").groupBy(*id_cols).agg(F.collect_set(F.struct("_whole", *carried)).alias("_asked"))
    sure = normed.select(*id_cols, "_norm").join(asked, id_cols).select(
        *id_cols, F.explode(F.filter("_asked", lambda s: T.padded_contains(F.col("_norm"), s["_whole"]))).alias("_s")).select(*id_cols, *[F.col("_s")[c].alias(c) for c in carried])
    return met.where("_whole is null").select(*id_cols, *carried).union(sure)


def _by_positions(normed: DataFrame, id_cols: list[str], entries: DataFrame) -> DataFrame:
    """(ids..., skill) of keys that several texts share, whose places count together.

    A phrase of several words is theirs where just one text has each of its further words at its
    place, so equal copies hold single words only.
    """
    from jobsift.operators.dedup import cut_lineage
    parts = cut_lineage(entries.select("skill").distinct().select("skill", F.split("skill", " ").alias("_parts"))
                        .select("skill", F.size("_parts").alias("_length"), F.posexplode("_parts").alias("_at", "_word")))
    split = normed.select(*id_cols, F.split("_norm", " ").alias("_words"))
    held = cut_lineage(split.select(*id_cols, F.posexplode("_words").alias("_pos", "_word")).join(parts.select("_word").distinct(), "_word", "left_semi"))
    counted = parts.join(held.groupBy("_word").agg(F.count(F.lit(1)).alias("_n")), "_word")
    rarest = (counted.groupBy("skill", "_length").agg(F.count(F.lit(1)).alias("_found"), F.min_by(F.struct("_at", "_word"), F.struct("_n", "_at")).alias("_r"))
              .where("_found = _length").select("skill", "_length", "_r._at", "_r._word"))
    starts = held.join(rarest, "_word").where("_pos >= _at").select(*id_cols, "skill", "_length", (F.col("_pos") - F.col("_at")).alias("_start"), F.col("_at").alias("_lead"))
    asked = starts.where("_length > 1").join(parts.drop("_length"), "skill").where("_at <> _lead")
    met = (asked.select(*id_cols, "skill", "_length", "_start", "_word", (F.col("_start") + F.col("_at")).alias("_pos"))
           .join(held, [*id_cols, "_word", "_pos"]).groupBy(*id_cols, "skill", "_length", "_start").agg(F.count(F.lit(1)).alias("_met")).where("_met = _length - 1"))
    return starts.where("_length = 1").select(*id_cols, "skill").union(met.select(*id_cols, "skill"))


def _runs(words: Column, n: int) -> Column:
    """Every ``n`` words of the array that follow each other, joined by a space."""
    later = F.slice(words, n, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    return F.transform(later, lambda w, i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n - 1)], w))


def with_features(df: DataFrame, text: Column, name: str, skills=FIXTURE_SKILLS, levels=FIXTURE_LEVELS,
                  id_cols: list[str] | None = None) -> DataFrame:
    """Normalise ``text`` once (own projection), then add its features as ``name``.

    ``skills`` are pairs or a DataFrame (skill, kind), ``levels`` pairs or a DataFrame
    (skill, level). The table paths need ``id_cols``, a unique key of ``df``, and write the
    normalised texts once in the checkpoint folder.
    """
    normed = df.withColumn("_norm", T.normalize_text(text))
    skill_table, level_table = isinstance(skills, DataFrame), isinstance(levels, DataFrame)
    if skill_table or level_table:
        if not id_cols:
            raise ValueError("a dictionary table needs id_cols naming a unique key of the texts")
        from jobsift.operators.dedup import cut_lineage
        normed = cut_lineage(normed)
    found, level = (None if skill_table else skills_found(F.col("_norm"), skills)), (None if level_table else level_of(F.col("_norm"), levels))
    out = normed
    if skill_table:
        entry = F.named_struct(F.lit("skill"), F.col("skill"), F.lit("kind"), F.col("kind"))
        out = out.join(phrases_by_join(normed, id_cols, skills, "kind").groupBy(*id_cols).agg(F.collect_list(entry).alias("_sk")), id_cols, "left")
        found = F.coalesce(F.col("_sk"), F.array().cast("array<struct<skill:string,kind:string>>"))
    if level_table:
        out = out.join(phrases_by_join(normed, id_cols, levels, "level").groupBy(*id_cols).agg(F.max("level").alias("_lv")), id_cols, "left")
        level = F.coalesce(F.col("_lv"), F.lit(0)).cast("int")
    return out.withColumn(name, F.named_struct(F.lit("skills"), found, F.lit("level"), level)).drop("_norm", "_sk", "_lv")


def rubric(job_skills: Column, job_level: Column, cv_skills: Column, cv_level: Column) -> Column:
    """H1 as an expression over both sides' features -> struct(hard, level, domain, score, rationale).

    hard = 40·|J∩C| div |J| over hard skills (40 if J empty); domain = 20·|J∩C| div |J|
    (20 if J empty); level = 40 − 20·min(gap, 2) with gap = max(0, level_J − level_C).
    """
    names = F.transform(cv_skills, lambda e: e["skill"])

    def part(kind: str) -> tuple[Column, Column]:
        need = F.array_distinct(F.transform(F.filter(job_skills, lambda e: e["kind"] == kind), lambda e: e["skill"]))
        return need, F.array_intersect(need, names)

    return _rubric(part("hard"), part("domain"), job_level, cv_level)


def _rubric(hard_skills: tuple[Column, Column], domain_skills: tuple[Column, Column], job_level: Column, cv_level: Column) -> Column:
    """``rubric`` of the skills needed and those of them that are there, by kind."""
    def part(need: Column, got: Column, weight: int) -> Column:
        return F.when(F.size(need) == 0, F.lit(weight)).otherwise(F.floor(weight * F.size(got) / F.size(need))).cast("int")

    hard, domain = part(*hard_skills, W_HARD), part(*domain_skills, W_DOMAIN)
    gap = F.greatest(F.lit(0), job_level - cv_level)
    level = (F.lit(W_LEVEL) - 20 * F.least(gap, F.lit(2))).cast("int")
    # Weakest part relative to its weight; ties go hard, level, domain.
    d2 = domain * 2
    rationale = (
        F.when((hard <= level) & (hard <= d2), F.lit(RATIONALE_HARD))
        .when(level <= d2, F.lit(RATIONALE_LEVEL))
        .otherwise(F.lit(RATIONALE_DOMAIN))
    )
    # named_struct keeps the field names inside higher-order lambdas too.
    return F.named_struct(F.lit("hard"), hard, F.lit("level"), level, F.lit("domain"), domain,
                          F.lit("score"), hard + level + domain, F.lit("rationale"), rationale)


def rubric_score(pairs: DataFrame, cvs: DataFrame, jobs: DataFrame, skills=FIXTURE_SKILLS, levels=FIXTURE_LEVELS,
                 job_key: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """H1: score every row of ``pairs(cv_id, <job_key>, ...)``.

    ``cvs``: cv_id, cv_text. ``jobs``: <job_key>, job_text (already C8-selected). Each text
    is normalised and matched against the dictionary once; pairs then meet both feature
    rows by equi-joins. The rows of ``pairs`` come back with hard, level, domain, score and
    rationale. Of a dictionary table the features are numbers (``_scored_by_table``).
    """
    key = list(job_key)
    if isinstance(skills, DataFrame):
        return _scored_by_table(pairs, cvs, jobs, skills, levels, key)
    cv_f = with_features(cvs.select("cv_id", "cv_text"), T.truncate_cv("cv_text"), "_c", skills, levels, ["cv_id"]).select("cv_id", "_c")
    job_f = with_features(jobs.select(*key, "job_text"), F.col("job_text"), "_j", skills, levels, key).select(*key, "_j")
    p = pairs.join(job_f, key).join(cv_f, "cv_id")
    r = rubric(F.col("_j.skills"), F.col("_j.level"), F.col("_c.skills"), F.col("_c.level"))
    return p.withColumn("_r", r).select(*pairs.columns, "_r.*")


def _numbered(skills: DataFrame) -> DataFrame:
    """(skill, _no, _kinds) of a table (skill, kind): each normalised skill with a number, and its kinds as bits."""
    from jobsift.operators.dedup import cut_lineage
    bit = F.when(F.col("kind") == "hard", 1).when(F.col("kind") == "domain", 2).otherwise(0)
    named = skills.select(T.normalize_text("skill").alias("skill"), "kind").where("skill <> ''")
    return cut_lineage(named.groupBy("skill").agg(F.bit_or(bit).alias("_kinds")).where("_kinds > 0").withColumn("_no", F.monotonically_increasing_id()))


def _numbered_features(df: DataFrame, text: Column, id_cols: list[str], numbers: DataFrame, levels) -> tuple[DataFrame, int]:
    """(ids..., _hard, _domain, _level) of every row of ``df``, skills as arrays of numbers, and how many numbers there are."""
    from jobsift.operators.dedup import cut_lineage
    normed = cut_lineage(df.select(*id_cols, T.normalize_text(text).alias("_norm")))
    kinds = F.col("_kinds")
    listed = lambda bit: F.collect_list(F.when(kinds.bitwiseAND(F.lit(bit)) > 0, F.col("_no")))
    sets = _matched(normed, id_cols, numbers, ["_no", "_kinds"]).groupBy(*id_cols).agg(listed(1).alias("_hard"), listed(2).alias("_domain"))
    if isinstance(levels, DataFrame):
        found = phrases_by_join(normed, id_cols, levels, "level").groupBy(*id_cols).agg(F.max("level").alias("_lv"))
        level = normed.select(*id_cols).join(found, id_cols, "left").select(*id_cols, F.coalesce(F.col("_lv"), F.lit(0)).cast("int").alias("_level"))
    else:
        level = normed.select(*id_cols, level_of(F.col("_norm"), levels).alias("_level"))
    none = F.array().cast("array<bigint>")
    rows = level.join(sets, id_cols, "left").select(*id_cols, F.coalesce("_hard", none).alias("_hard"), F.coalesce("_domain", none).alias("_domain"), "_level")
    out, told = cut_lineage(rows, {"n": F.sum(F.size("_hard") + F.size("_domain"))})
    return out, told["n"] or 0


def _scored_by_table(pairs: DataFrame, cvs: DataFrame, jobs: DataFrame, skills: DataFrame, levels, key: list[str]) -> DataFrame:
    """``rubric_score`` with a dictionary table.

    A kind belongs to a skill of the dictionary, whichever text has it, so the skills needed
    are met within their kind. A pair carries no skills through a shuffle where this moves
    more than sending the CVs' skills to groups of jobs: a group, of about ``HELD`` numbers
    or one job, is broadcast, one after the other.
    """
    from jobsift.operators.dedup import cut_lineage
    numbers = _numbered(skills)
    cv_f, cv_n = _numbered_features(cvs, T.truncate_cv("cv_text"), ["cv_id"], numbers, levels)
    job_f, job_n = _numbered_features(jobs, F.col("job_text"), key, numbers, levels)
    cv_f = cv_f.toDF("cv_id", "_ch", "_cd", "_cl")
    both = lambda a, b: (F.col(a), F.array_intersect(a, b))

    def scored(of: DataFrame, features: DataFrame) -> DataFrame:
        r = _rubric(both("_hard", "_ch"), both("_domain", "_cd"), F.col("_level"), F.col("_cl"))
        return of.join(cv_f, "cv_id").join(features, key).withColumn("_r", r).select(*pairs.columns, "_r.*")

    groups = max(1, -(-job_n // HELD))
    carried = pairs.count() * job_n / max(1, job_f.count())
    if groups > MOST_GROUPS or groups * cv_n > carried + HELD:
        return scored(pairs, job_f)
    if groups == 1:
        return scored(pairs, F.broadcast(job_f))
    group = F.pmod(F.xxhash64(*key), F.lit(groups))
    shares = [cut_lineage(scored(pairs.where(group == g), F.broadcast(job_f.where(group == g)))) for g in range(groups)]
    return reduce(DataFrame.union, shares)


# --- H3-H6: replies of a batch inference job -----------------------------------

def _one_json_value(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null.

    The parser stops after the first value. What follows it can't end a list and an object
    alike, so the text must stand whole within both, alone in the list.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    alone = held.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))


def parse_reply(replies: DataFrame) -> DataFrame:
    """H3-H5: reply text (+ error text) -> score, rationale, status.

    status: ok | error (non-abort failure: score 0) | abort (rate limit, or JSON that is
    not an object) | non_numeric (a text score; the reference's comparison would raise).
    ``score`` keeps null for an explicit JSON null; absent key -> 0 (H4); a boolean is 1
    or 0, as it compares in the reference. Of a key given twice the last counts, in sessions
    that ``jobsift.session`` made or prepared (elsewhere such a reply is no JSON). All other columns of ``replies`` pass through.
    """
    v = _one_json_value(F.col("reply"))
    kind = F.schema_of_variant(v)
    score_v = F.try_variant_get(v, "$.score", "variant")
    score_type = F.when(score_v.isNotNull(), F.schema_of_variant(score_v))
    is_object = v.isNotNull() & kind.startswith("OBJECT<")
    numeric = score_type.isin("BOOLEAN", "BIGINT", "DOUBLE", "INT", "TINYINT", "SMALLINT", "FLOAT") | score_type.startswith("DECIMAL")
    present = score_v.isNotNull()
    status = (
        F.when(error_class(F.col("error")) == "abort", F.lit("abort"))
        .when(F.col("error").isNotNull() | v.isNull(), F.lit("error"))
        .when(~is_object, F.lit("abort"))
        .when(present & (score_type != "VOID") & ~numeric, F.lit("non_numeric"))
        .otherwise(F.lit("ok"))
    )
    score = (
        F.when(status == "error", F.lit(0.0))
        .when(status != "ok", F.lit(None).cast("double"))
        .when(~present, F.lit(0.0))
        .when(score_type == "BOOLEAN", F.try_variant_get(v, "$.score", "boolean").cast("double"))
        .otherwise(F.try_variant_get(v, "$.score", "double"))
    )
    rat_v = F.try_variant_get(v, "$.rationale", "string")
    rat_present = F.try_variant_get(v, "$.rationale", "variant").isNotNull()
    rationale = (
        F.when(status == "error", F.lit(ERROR_RATIONALE))
        .when(status != "ok", F.lit(None).cast("string"))
        .when(~rat_present, F.lit(NO_RATIONALE))
        .otherwise(rat_v)
    )
    keys = [c for c in replies.columns if c not in ("reply", "error")]
    return replies.select(*keys, status.alias("status"), score.alias("score"), rationale.alias("rationale"))


def error_class(error: Column) -> Column:
    """H5: 'abort' for rate-limit texts, 'error' for other failures, null for none."""
    rate = F.exists(F.array(*[F.lit(m) for m in ABORT_MARKERS]), lambda m: F.lower(error).contains(m))
    return F.when(error.isNotNull(), F.when(rate, F.lit("abort")).otherwise(F.lit("error")))


def batch_abort(parsed: DataFrame) -> DataFrame:
    """H6: drop every row of a search in which any reply aborts."""
    aborted = parsed.groupBy("search_id").agg(F.bool_or(F.col("status") == "abort").alias("_ab")).where("_ab")
    return parsed.join(aborted.select("search_id"), "search_id", "left_anti")


def attach_scores(postings: DataFrame, scores: DataFrame, keys=("search_id", "seq")) -> DataFrame:
    """H7: score and rationale onto the posting rows (left join, unscored stay null)."""
    return postings.join(scores, list(keys), "left")
