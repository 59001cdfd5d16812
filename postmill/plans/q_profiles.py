"""Profile, repository and streaming queries."""

from pyspark.sql import functions as F

from postmill.operators import profiles as p
from postmill.plans.fixtures import FIXTURES
from postmill.plans.registry import query

c = F.col

# Parts play repositories: names, files, languages and readme words come from their columns.
FIXTURES["repo_rows"] = """
SELECT p_partkey AS repo, p_name, p_size,
  CASE p_partkey % 4 WHEN 0 THEN 'package.json,tsconfig.json' WHEN 1 THEN 'pom.xml,README.md' WHEN 2 THEN 'Dockerfile,requirements.txt,pyproject.toml' ELSE 'x.txt' END AS files,
  CASE p_partkey % 3 WHEN 0 THEN 'Uses React and redis with ' || p_name WHEN 1 THEN 'Scrapy crawler for ' || p_name ELSE 'Plain ' || p_name || ' notes' END AS readme,
  CASE WHEN p_partkey % 5 = 0 THEN ' Tool for ' || p_brand || ' ' END AS description, p_partkey % 7 AS stars, p_partkey % 3 AS forks
FROM part
"""


def repos(i):
    df = i.view("repo_rows").withColumns({
        "files": F.split("files", ","),
        "languages": F.create_map(F.lit("Go"), c("p_size"), F.lit("C"), F.lit(25), F.lit("Lua"), F.lit(1), F.lit("Perl"), F.lit(0), F.lit("Awk"), F.lit(-1)),
    })
    return p.stack_signals(df, "files", "languages", "readme")


STACK = """array_to_string(list_filter(CASE repo % 4 WHEN 0 THEN ['Node.js', 'TypeScript'] WHEN 1 THEN ['Java', 'Maven'] WHEN 2 THEN ['Docker', 'Python'] ELSE [] END, lambda z: true)
  || CASE WHEN p_size >= 25 THEN ['Go', 'C', 'Lua', 'Perl'] WHEN p_size >= 1 THEN ['C', 'Go', 'Lua', 'Perl'] ELSE ['C', 'Lua', 'Go', 'Perl'] END
  || CASE repo % 3 WHEN 0 THEN ['React', 'Redis'] WHEN 1 THEN ['Scrapy'] ELSE [] END, '|')"""


@query("stack_signals", f"SELECT repo, array_to_string(string_split({STACK}, '|')[1:8], '|') AS stack FROM repo_rows")
def _(i):
    return repos(i).select("repo", F.array_join("stack_signals", "|").alias("stack"))


@query("project_type", """
SELECT doc_id, CASE WHEN regexp_matches(t, 'scrap|crawl|selenium|playwright|beautifulsoup|scrapy') THEN 'scraper' WHEN regexp_matches(t, 'bot|telegram|discord|slack') THEN 'bot'
  WHEN regexp_matches(t, 'machine learning|deep learning|neural|pytorch|tensorflow|scikit-learn|notebook') THEN 'ml' WHEN regexp_matches(t, 'react|next|vue|angular|frontend|tailwind|vite') THEN 'frontend'
  WHEN regexp_matches(t, 'api|fastapi|flask|django|express|nestjs|graphql|backend') THEN 'api' WHEN regexp_matches(t, 'automation|script|cli|workflow|cron') THEN 'automation' ELSE 'general' END AS project_type
FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def _(i):
    return i.table("documents").select("doc_id", p.project_type(c("text")).alias("project_type"))


@query("project_goal", r"""
SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN 'Shows ' || source WHEN length(t) < 40 THEN 'Public repository with unclear end-user goal' WHEN length(t) <= 220 THEN t
  ELSE rtrim(substr(t, 1, 217)) || '...' END) AS goal_md5 FROM (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def _(i):
    df = i.sql("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' Shows ' || source || ' ' END AS description, '# ' || text || ' [link](http://x) ```code```' AS readme FROM documents")
    return df.select("doc_id", F.md5(p.project_goal(c("description"), c("readme"))).alias("goal_md5"))


def scored(i):
    df = repos(i).withColumns({
        "stargazers_count": c("stars"), "forks_count": c("forks"), "homepage": F.when(c("repo") % 2 == 0, F.lit("h")), "is_pinned": c("repo") % 3 == 0,
        "sampled_commit_count": (c("repo") % 4).cast("int"), "archived": c("repo") % 11 == 0})
    return p.repo_score(df)


@query("repo_score", f"""
SELECT repo, CAST(stars * 5 + forks * 3 + CASE WHEN repo % 2 = 0 THEN 12 ELSE 0 END + CASE WHEN repo % 3 = 0 THEN 10 ELSE 0 END + 8 + CASE WHEN repo % 4 > 0 THEN 6 ELSE 0 END
  + least(len(string_split({STACK}, '|')), 5) * 2 - CASE WHEN repo % 11 = 0 THEN 20 ELSE 0 END AS BIGINT) AS resume_score FROM repo_rows""")
def _(i):
    return scored(i).select("repo", "resume_score")


@query("repo_bullets", f"""
SELECT repo, 'Built and maintained a tool project focused on ' || CASE WHEN description IS NULL THEN 'public repository with unclear end-user goal' ELSE lower(trim(description)) END
  || '.#Worked with ' || array_to_string(string_split({STACK}, '|')[1:5], ', ') || ' and published the solution as a public GitHub repository.'
  || CASE WHEN repo % 4 > 0 THEN '#Shipped at least ' || (repo % 4) || ' sampled commits with visible public development activity.' ELSE '' END AS bullets FROM repo_rows""")
def _(i):
    df = scored(i).withColumns({"project_type": F.lit("tool"), "business_goal": p.project_goal(c("description"), F.lit(None).cast("string"))})
    return p.repo_bullets(df).select("repo", F.array_join("resume_bullets", "#").alias("bullets"))


@query("activity_summary", """
SELECT user_id AS repo, count(*) AS sampled_commit_count, count(DISTINCT CAST(ts AS DATE)) AS active_days,
  CAST(greatest(floor(epoch_us(max(ts)) / 86400000000.0 - epoch_us(min(ts)) / 86400000000.0), 1) AS BIGINT) AS window_days FROM events GROUP BY 1""")
def _(i):
    out = p.activity_summary(i.sql("SELECT user_id AS repo, ts FROM events"), "repo", "ts")
    return out.select("repo", "sampled_commit_count", "active_days", c("window_days").cast("long").alias("window_days"))


@query("profile_skill_merge", """
WITH u AS (SELECT cand_id, skill, 0 AS src FROM candidate_skills WHERE skill LIKE 'red %' OR skill LIKE 'blue %' UNION ALL SELECT cand_id, upper(skill), 1 FROM candidate_skills WHERE skill LIKE '% gear'),
r AS (SELECT *, row_number() OVER (PARTITION BY cand_id, lower(skill) ORDER BY src) AS rn FROM u)
SELECT cand_id, skill, CAST(src AS BIGINT) AS src FROM r WHERE rn = 1""")
def _(i):
    first = i.sql("SELECT cand_id, ' ' || skill || ' ' AS skill, 1 AS seq FROM candidate_skills WHERE skill LIKE 'red %' OR skill LIKE 'blue %'")
    second = i.sql("SELECT cand_id, upper(skill) AS skill, 1 AS seq FROM candidate_skills WHERE skill LIKE '% gear'")
    return p.merge_skills([first, second], "cand_id").select("cand_id", "skill", c("src").cast("long").alias("src"))


@query("stream_ingest_upsert", """
WITH v AS (SELECT event_id, user_id, event_type, value, ts FROM events UNION ALL
  SELECT event_id, user_id, 'edited', value + 1000, ts + INTERVAL 1 HOUR FROM events WHERE event_id % 10 = 3),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts DESC) AS rn FROM v) WHERE rn = 1)
SELECT event_id, user_id, event_type, value FROM l WHERE ts >= (SELECT max(ts) FROM v) - INTERVAL 7 DAY""")
def _(i):
    """Events arrive as files, each of them twice, then a tenth of them edited; the last edit counts, and old ones expire."""
    from postmill.sources.stored import StoredTable
    from postmill.sources.tables import scratch_path
    from postmill.streaming import ingest

    folder = scratch_path(i.spark, "stream")
    events = i.table("events").withColumn("ts", c("ts").cast("timestamp"))
    events.unionByName(events).repartition(4, "event_type").write.parquet(f"{folder}/in")
    table = StoredTable.create(events.limit(0), f"{folder}/table", ["event_id"], "ts", 8)
    edited = events.filter("event_id % 10 = 3").withColumns({"event_type": F.lit("edited"), "value": c("value") + 1000, "ts": c("ts") + F.expr("INTERVAL 1 HOUR")})
    for arrived in (None, edited):
        if arrived is not None:
            arrived.write.mode("append").parquet(f"{folder}/in")
        arrivals = ingest.read_arrivals(i.spark, f"{folder}/in", events.schema)
        ingest.stream_into(arrivals, table, ["event_id"], "ts", f"{folder}/staging", f"{folder}/progress").awaitTermination()
    return table.read().select("event_id", "user_id", "event_type", "value")
