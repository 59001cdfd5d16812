"""Skills in text, candidates against postings, skill gaps and résumé facts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import contains_any, let, squeeze
from postmill.operators.setsearch import best_sets
from postmill.operators.spread import HOT_SHARE, SALTS, head_per_key, keep_first
from postmill.session import ensure_checkpoint_dir

c = F.col

# Two-letter skills that may be looked for in text.
SHORT_SKILLS = ["ai", "bi", "ci", "ml", "nlp", "qa", "ui", "ux", "go", "c#", "c++", "1c", "hr"]
WORD = "[\\p{L}\\p{N}_]"


def vocabulary_keys(vocab: DataFrame) -> DataFrame:
    """(skill, key): one spelling per key, the most frequent; too short words, and keys without a letter or digit, left out."""
    keyed = vocab.withColumn("key", F.lower(F.trim("skill"))).filter(
        ((F.length("key") > 2) | c("key").isin(SHORT_SKILLS)) & c("key").rlike(WORD))
    return keep_first(keyed, ["key"], [F.desc("n_mentions"), F.asc("skill")]).select("skill", "key")


#: States of a vocabulary that are broadcast at most (some 100 bytes each).
BROADCAST_STATES = 200_000
#: Bits of the table of words that longer keys begin with.
FIRST_BITS = 1 << 16


def vocabulary_trie(vocab: DataFrame) -> DataFrame:
    """(state, depth, more, ends): the prefixes of the vocabulary's keys, word by word, as the states of an automaton.

    A state is the text of the first ``depth`` words of a key with what lies between them. ``more`` tells whether a longer state goes on
    from it; ``ends`` are the keys that are complete there, with what stands before their first and after their last word.
    """
    keys = vocabulary_keys(vocab).select("skill", "key", F.regexp_extract_all("key", F.lit(f"{WORD}+"), F.lit(0)).alias("w"), F.split("key", f"{WORD}+", -1).alias("s"))
    steps = keys.select("skill", "key", "s", F.size("w").alias("n"), F.posexplode("w").alias("at", "word"), "w")
    inner = F.transform(F.slice("w", F.lit(2), c("at")), lambda x, k: F.concat(F.get(c("s"), k + 1), x))
    state = F.concat(F.get(c("w"), F.lit(0)), F.array_join(inner, ""))
    end = F.struct("skill", "key", F.get(c("s"), F.lit(0)).alias("pre"), F.get(c("s"), c("n")).alias("post"))
    rows = steps.select(state.alias("state"), (c("at") + 1).alias("depth"), (c("at") + 1 < c("n")).alias("more"), F.when(c("at") + 1 == c("n"), end).alias("end"))
    return rows.groupBy("state", "depth").agg(F.bool_or("more").alias("more"), F.collect_list("end").alias("ends"))


def _reach(rows: DataFrame, states: DataFrame, small: bool, spread: str) -> DataFrame:
    """Rows whose ``state`` the automaton has: states broadcast where their number allows it, else by a join in which frequent states are dealt by ``spread``."""
    if small:
        return rows.join(F.broadcast(states), "state")
    counts = rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    # At most HOT_SHARE states are above that share of all rows.
    hot = counts.filter(c("n") > total / F.lit(HOT_SHARE)).select("state", F.lit(True).alias("hot"))
    dealt = rows.join(F.broadcast(hot), "state", "left").withColumn("salt", F.when(c("hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    copies = states.join(F.broadcast(hot), "state", "left").withColumn("salt", F.explode(F.when(c("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("hot").join(copies.drop("hot"), ["state", "salt"]).drop("salt")


def _first_words(states: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for the given states and for few other words: a bit per hash, FIRST_BITS of them (8 KB)."""
    at = F.xxhash64("state").bitwiseAND(F.lit(FIRST_BITS - 1))
    words = states.select(at.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b")).collect()
    bits = [0] * (FIRST_BITS >> 6)
    for r in words:
        bits[r["w"]] = r["b"]
    table = F.from_json(F.lit(json.dumps(bits)), "array<bigint>")

    def may(word: Column) -> Column:
        p = F.xxhash64(word).bitwiseAND(F.lit(FIRST_BITS - 1))
        return F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1

    return may


def find_skills(docs: DataFrame, doc_id: str, text: str, vocab: DataFrame, max_hits: int | None = None) -> DataFrame:
    """(doc_id, skill, hit_no): skills found as whole words, longest first, with their number; the first ``max_hits`` if given (40 are published).

    The vocabulary is an automaton in a table (``vocabulary_trie``). The distinct words of a text meet the keys of one word by an equi join.
    A word that longer keys, or keys with signs, begin with goes on with the few words after it: it takes the next one and meets the
    states again, once for each further word of the longest key. What stands between the words must be the key's own, and a sign before or
    after it no part of a word. No pattern is run on a hit, and no text is shuffled: with a vocabulary of up to BROADCAST_STATES states words
    meet it where they are, beyond it they travel by state.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    trie = vocabulary_trie(vocab).checkpoint()
    size = trie.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("depth"), F.lit(1)).alias("depth")).first()
    depth, small = size["depth"], size["n"] <= BROADCAST_STATES
    signed = lambda e: (e["pre"] != "") | (e["post"] != "")
    firsts = trie.filter(c("depth") == 1)
    plain = firsts.select("state", F.inline(F.filter("ends", lambda e: ~signed(e)))).drop("pre", "post")
    opening = _first_words(firsts.filter(c("more") | F.exists("ends", signed)))

    low = F.lower(F.coalesce(c(text), F.lit("")))
    split = docs.select(c(doc_id).alias("_doc"), F.regexp_extract_all(low, F.lit(f"{WORD}+"), F.lit(0)).alias("w"), F.split(low, f"{WORD}+", -1).alias("s"))
    hit = F.struct((-F.length("key")).alias("size"), "key", "skill").alias("hit")
    found = _reach(split.select("_doc", F.explode(F.array_distinct("w")).alias("state")), plain, small, "_doc").select("_doc", hit)
    places = F.filter(F.transform("w", lambda x, i: F.when(opening(x), i)), lambda i: i.isNotNull())
    units = F.transform(places, lambda i: F.struct(
        F.get(c("w"), i).alias("state"), F.get(c("s"), i).alias("before"), (i == 0).alias("first"), F.slice("w", i + 2, F.lit(depth)).alias("nw"), F.slice("s", i + 2, F.lit(depth + 1)).alias("ns")))
    rows = split.select("_doc", F.inline(units))
    for d in range(1, depth + 1):
        met = _reach(rows, trie.filter(c("depth") == d).drop("depth"), small, "_doc")
        after = F.get(c("ns"), F.lit(d - 1))
        pre, post = c("e.pre"), c("e.post")
        ends = met.select("_doc", "before", "first", "nw", after.alias("after"), F.explode("ends").alias("e")).filter(
            c("before").endswith(pre) & ((pre == "") | (F.length("before") > F.length(pre)) | c("first"))
            & c("after").startswith(post) & ((post == "") | (F.length("after") > F.length(post)) | (F.size("nw") < d)))
        found = found.unionByName(ends.select("_doc", "e.key", "e.skill").select("_doc", hit))
        # On to the next word, from the states that have one.
        rows = met.filter(c("more") & (F.size("nw") >= d)).select("_doc", F.concat("state", after, F.get(c("nw"), F.lit(d - 1))).alias("state"), "before", "first", "nw", "ns")
    hits = F.array_sort(F.collect_set("hit"))
    kept = found.groupBy("_doc").agg((hits if max_hits is None else F.slice(hits, 1, max_hits)).alias("hits"))
    return kept.select(c("_doc").alias(doc_id), F.posexplode("hits").alias("at", "hit")).select(doc_id, c("hit.skill").alias("skill"), (c("at") + 1).alias("hit_no"))


# ---- candidates and postings --------------------------------------------------------------

def _set_id(part: str, keys: str) -> Column:
    """Name of a part's skill set, safe to stand for it: SHA-256 of its JSON text."""
    return F.sha2(F.to_json(F.struct(c(part).alias("p"), c(keys).alias("k"))), 256)


def narrow_postings(postings: DataFrame, level: str | None = None, city: str | None = None, work_format: str | None = None, salary_min: float | None = None) -> DataFrame:
    """Postings that a candidate wants to see; a posting without a salary passes ``salary_min``."""
    wanted = {"level_filled": level, "city_norm": city, "work_format_norm": work_format}
    for name, value in wanted.items():
        if value:
            postings = postings.filter(c(name) == value)
    if salary_min is not None:
        postings = postings.filter(c("salary_avg_clean").isNull() | (c("salary_avg_clean") >= salary_min))
    return postings


def match(
    cands: DataFrame, cand_skills: DataFrame, postings: DataFrame, posting_skills: DataFrame,
    top_n: int, cand_part: str | None = None, posting_part: str | None = None,
) -> DataFrame:
    """Best ``top_n`` postings per candidate by Jaccard of skills, then salary, skill count and id.

    ``cands`` has one row per (cand_id[, part]); with parts (roles, say) a candidate
    only meets postings of its part. Exact, and no pair of sets is ever a row:

    * equal skill sets are matched once, for candidates and for postings (both kept in
      the checkpoint folder, as several steps read them);
    * sets are compared in blocks (``setsearch``), which put out the few best of each candidate set;
    * candidate sets short of matches are filled with the best postings of score 0,
      of which twice ``top_n`` per part are enough.
    """
    part_c = c(cand_part) if cand_part else F.lit("")
    part_p = c(posting_part) if posting_part else F.lit("")
    best_first = [c("salary_avg_clean").desc_nulls_last(), c("skills_count").desc_nulls_last(), F.asc("id")]
    ensure_checkpoint_dir(postings.sparkSession)

    # Postings with their set; equal sets share a signature and keep their best 2 * top_n postings, in one row.
    spelled = posting_skills.groupBy("id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    empty = F.array().cast("array<string>")
    p = postings.withColumn("part", part_p).filter(c("part").isNotNull()).join(spelled, "id", "left").select(
        "id", "part", "salary_avg_clean", F.coalesce("skills", empty).alias("skills"))
    keys = F.sort_array(F.array_distinct(F.transform("skills", lambda x: F.lower(x))))
    p = p.withColumn("keys", keys).withColumns({"skills_count": F.size("skills").cast("long"), "psig": F.unhex(_set_id("part", "keys"))})
    heads = head_per_key(p.drop("keys"), ["part", "psig"], best_first, 2 * top_n, "in_sig").withColumn("keys", keys)
    sets = heads.groupBy("part", "psig").agg(
        F.min_by("keys", "in_sig").alias("keys"), F.sort_array(F.collect_list(F.struct("in_sig", "id", "salary_avg_clean", "skills_count", "skills"))).alias("heads"))
    sets = sets.drop("psig").withColumn("no", F.monotonically_increasing_id()).checkpoint()
    lean = F.transform("heads", lambda x: F.struct(x["in_sig"].alias("in_sig"), x["id"].alias("id"), x["salary_avg_clean"].alias("salary_avg_clean"), x["skills_count"].alias("skills_count")))

    # Candidates with their set; equal sets are matched once.
    cs = cands.withColumn("part", part_c).join(
        cand_skills.select("cand_id", F.lower("skill").alias("key")).groupBy("cand_id").agg(F.sort_array(F.collect_set("key")).alias("ckeys")),
        "cand_id", "left").withColumn("ckeys", F.coalesce("ckeys", empty)).withColumn("csig", F.unhex(_set_id("part", "ckeys"))).select("cand_id", "part", "ckeys", "csig").checkpoint()
    csets = keep_first(cs.select("part", "csig", "ckeys"), ["csig"], [F.asc("csig")]).withColumn("no", F.monotonically_increasing_id()).checkpoint()

    first = F.get("heads", F.lit(0))
    offered = sets.select("no", "part", "keys", first["salary_avg_clean"].alias("salary_avg_clean"), first["skills_count"].alias("skills_count"), first["id"].alias("id"))
    pairs = best_sets(csets.select("no", "part", c("ckeys").alias("keys")), offered, best_first, top_n)
    ranked = pairs.join(offered.select(c("no").alias("offer_no"), "salary_avg_clean", "skills_count", "id"), "offer_no")
    top_sets = head_per_key(ranked, ["ask_no"], [F.desc("score"), *best_first], top_n, "set_no").select("ask_no", "offer_no", "score", "set_no").checkpoint()
    hits = top_sets.join(sets.select(c("no").alias("offer_no"), F.slice(lean, 1, top_n).alias("h")), "offer_no").select("ask_no", "offer_no", "score", F.inline("h"))

    # Score 0: the best postings overall, minus those that share a skill, for sets with fewer than top_n sets above it.
    best = head_per_key(sets.select("part", "no", "keys", F.inline(lean)), ["part"], best_first, 2 * top_n, "best_no")
    fill = best.groupBy("part").agg(F.collect_list(F.struct("no", "in_sig", "id", "salary_avg_clean", "skills_count", "keys")).alias("f"))
    short = csets.join(top_sets.filter(c("set_no") == top_n).select(c("ask_no").alias("no")), "no", "left_anti")
    zeros = short.select(c("no").alias("ask_no"), "part", "ckeys").join(fill, "part").select("ask_no", "ckeys", F.inline("f")).filter(~F.arrays_overlap("ckeys", "keys")).select(
        "ask_no", c("no").alias("offer_no"), F.lit(0.0).alias("score"), "in_sig", "id", "salary_avg_clean", "skills_count")
    order = [F.desc("score"), *best_first]
    final = head_per_key(hits.unionByName(zeros), ["ask_no"], order, top_n, "match_no")
    skills = F.element_at("heads", c("in_sig"))["skills"].alias("skills")
    final = final.join(sets.select(c("no").alias("offer_no"), "heads"), "offer_no").select("ask_no", "id", "score", "salary_avg_clean", "skills_count", "match_no", skills)
    final = final.withColumn("low", F.transform("skills", lambda x: F.lower(x)) == c("skills"))
    final = final.join(csets.select(c("no").alias("ask_no"), "csig"), "ask_no").drop("ask_no")

    out = cs.select("cand_id", "part", "csig", "ckeys").join(final, "csig")
    # Skills in lower case are keys as they are; in others each is looked for by its key.
    mine = lambda s: F.array_contains(c("ckeys"), F.lower(s))
    return out.select(
        "cand_id", "part", "id", "score", "salary_avg_clean", "skills_count", c("match_no").cast("long").alias("match_no"),
        F.when(c("low"), F.array_intersect("skills", "ckeys")).otherwise(F.filter("skills", mine)).alias("matched_skills"),
        F.when(c("low"), F.array_except("skills", "ckeys")).otherwise(F.filter("skills", lambda s: ~mine(s))).alias("missing_skills"),
    )


def mean_match(matches: DataFrame) -> DataFrame:
    """Mean score of a candidate's best matches, in percent."""
    return matches.groupBy("cand_id").agg((F.avg("score") * 100).alias("mean_match_pct"))


def skill_gap(df: DataFrame, have: str, want: str) -> DataFrame:
    """matched, missing and extra skills (sorted; spelling of the target), and the matched share of the target."""
    def sift(items: str, against: str, inside: bool) -> Column:
        keys = F.transform(against, lambda x: F.lower(x))
        return F.array_sort(F.array_distinct(let(keys, lambda ks: F.filter(
            items, lambda x: F.array_contains(ks, F.lower(x)) == F.lit(inside)))))

    out = df.withColumns({
        "matched": sift(want, have, True), "missing": sift(want, have, False), "extra": sift(have, want, False)})
    return out.withColumn("gap_score", F.when(F.size(want) > 0, F.size("matched") / F.size(want) * 100).otherwise(F.lit(0.0)))


# ---- résumés ------------------------------------------------------------------------------------

RESUME_LEVELS = [
    ("lead", ["lead", "head", "руковод", "team lead"]), ("senior", ["senior", "старш", "sr."]),
    ("middle", ["middle", "mid-level", "mid "]), ("intern", ["intern", "стаж", "trainee"]),
]


def resume_facts(df: DataFrame, text: str) -> DataFrame:
    """Years, level, english level and a 400-character preview of a résumé text."""
    t = F.regexp_replace(c(text), "^\\s+|\\s+$", "")
    low = F.lower(t)
    level = F.lit("junior")
    for name, words in reversed(RESUME_LEVELS):
        level = F.when(contains_any(low, words), F.lit(name)).otherwise(level)
    return df.withColumns({
        "years_experience": F.regexp_extract(t, "(?iu)(\\d+)\\+?\\s*(?:years|year|лет|года|год)", 1).try_cast("long"),
        "current_level": level,
        "english_level": F.upper(F.nullif(F.regexp_extract(t, "(?iU)\\b(a1|a2|b1|b2|c1|c2)\\b", 1), F.lit(""))),
        "preview": F.substring(t, 1, 400),
    })


def resume_summary(df: DataFrame, resume_id: str, text: str, vocab: DataFrame) -> DataFrame:
    found = find_skills(df, resume_id, text, vocab)
    lists = found.groupBy(resume_id).agg(F.sort_array(F.collect_list(F.struct("hit_no", "skill"))).alias("_h"))
    out = resume_facts(df, text).drop(text).join(lists, resume_id, "left")
    return out.withColumn("skills", F.coalesce(c("_h.skill"), F.array().cast("array<string>"))).drop("_h")


def resume_notes(df: DataFrame, missing: str, matched: str, percentile: str) -> DataFrame:
    """Advice lines from a gap result."""
    first = lambda x: F.array_join(F.slice(x, 1, 8), ", ")
    return df.withColumn("notes", F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit("Add explicit evidence for these market-critical skills: "), first(missing), F.lit("."))),
        F.when(F.size(matched) > 0, F.concat(
            F.lit("Prominently surface matched skills near the top of the resume: "), first(matched), F.lit("."))),
        F.when(c(percentile) < 50, F.lit(
            "The current profile sits below the median market-fit threshold for this target. Strengthen both core tools and delivery outcomes.")),
        F.lit("Convert generic responsibility bullets into quantified impact statements with tools, scale, and business results."),
    )))


def salary_position(expected: Column, market: Column) -> Column:
    """Expected salary against the market: below 0.9, above 1.1, else at."""
    e, m = expected.cast("double"), market.cast("double")
    return (
        F.when(e.isNull() | m.isNull() | (e == 0) | (m == 0), "unknown").when(e < m * 0.9, "below").when(e > m * 1.1, "above").otherwise("at"))


def token_skills(text: Column, n: int | None = None) -> Column:
    """Items of a free list of skills; the first ``n`` only, if given (the published reading takes 20)."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[,;/\\n]"), lambda x: squeeze(x))
    items = F.filter(parts, lambda x: x != "")
    return items if n is None else F.slice(items, 1, n)


#: Missing skills that are shown of each match, as published; the matches hold all of them.
SHOWN_SKILLS = 8


def shown_skills(skills: Column, n: int = SHOWN_SKILLS) -> Column:
    """The first few of a list of skills, for display."""
    return F.slice(skills, 1, n)

