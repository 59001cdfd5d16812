"""Code-host profiles: stack signals, project type and goal, scores, activity, merged skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import contains_any, let, squeeze
from postmill.operators.spread import head_per_key, keep_first

c = F.col

# Files, words and project types that name a stack.
FILE_SIGNALS = {
    "package.json": ["Node.js"],
    "requirements.txt": ["Python"],
    "pyproject.toml": ["Python"],
    "Pipfile": ["Python"],
    "Dockerfile": ["Docker"],
    "docker-compose.yml": ["Docker Compose"],
    "docker-compose.yaml": ["Docker Compose"],
    "pom.xml": ["Java", "Maven"],
    "build.gradle": ["Java", "Gradle"],
    "Cargo.toml": ["Rust"],
    "go.mod": ["Go"],
    "composer.json": ["PHP"],
    "Gemfile": ["Ruby"],
    "next.config.js": ["Next.js"],
    "next.config.ts": ["Next.js"],
    "vite.config.js": ["Vite"],
    "vite.config.ts": ["Vite"],
    "tsconfig.json": ["TypeScript"],
    "tailwind.config.js": ["Tailwind CSS"],
    "tailwind.config.ts": ["Tailwind CSS"],
}
KEYWORD_SIGNALS = {
    "react": "React",
    "next": "Next.js",
    "vue": "Vue",
    "nuxt": "Nuxt",
    "svelte": "Svelte",
    "fastapi": "FastAPI",
    "flask": "Flask",
    "django": "Django",
    "express": "Express",
    "nestjs": "NestJS",
    "playwright": "Playwright",
    "selenium": "Selenium",
    "beautifulsoup": "BeautifulSoup",
    "scrapy": "Scrapy",
    "tensorflow": "TensorFlow",
    "pytorch": "PyTorch",
    "scikit-learn": "scikit-learn",
    "pandas": "pandas",
    "numpy": "NumPy",
    "postgres": "PostgreSQL",
    "mongodb": "MongoDB",
    "redis": "Redis",
    "tailwind": "Tailwind CSS",
    "docker": "Docker",
}
TYPE_RULES = [
    ("scraper", ["scrap", "crawl", "selenium", "playwright", "beautifulsoup", "scrapy"]),
    ("bot", ["bot", "telegram", "discord", "slack"]),
    ("ml", ["machine learning", "deep learning", "neural", "pytorch", "tensorflow", "scikit-learn", "notebook"]),
    ("frontend", ["react", "next", "vue", "angular", "frontend", "tailwind", "vite"]),
    ("api", ["api", "fastapi", "flask", "django", "express", "nestjs", "graphql", "backend"]),
    ("automation", ["automation", "script", "cli", "workflow", "cron"]),
]
UNCLEAR_GOAL = "Public repository with unclear end-user goal"


def stack_signals(df: DataFrame, files: str, languages: str, text: str, limit: int = 8) -> DataFrame:
    """Up to eight labels in order: from root files, the four largest languages, then words of file contents and readme.

    ``files`` is an array, ``languages`` a map to bytes.
    """
    by_file = F.create_map(*[y for k, x in FILE_SIGNALS.items() for y in (F.lit(k), F.array(*[F.lit(i) for i in x]))])
    from_files = F.flatten(F.filter(F.transform(files, lambda f: F.try_element_at(by_file, f)), lambda x: x.isNotNull()))
    # Largest first; equal sizes keep the order of the map.
    sized = F.transform(F.map_entries(languages), lambda e, i: F.struct((-e["value"]).alias("n"), i.alias("i"), e["key"].alias("k")))
    top = F.slice(F.transform(F.array_sort(sized), lambda s: s["k"]), 1, 4)
    empty = F.array().cast("array<string>")
    words = let(F.lower(F.coalesce(c(text), F.lit(""))), lambda t: F.array_compact(F.array(
        *[F.when(F.contains(t, F.lit(w)), F.lit(label)) for w, label in KEYWORD_SIGNALS.items()])))
    every = F.concat(F.coalesce(from_files, empty), F.coalesce(top, empty), words)
    return df.withColumn("stack_signals", F.slice(F.array_distinct(F.filter(every, lambda x: x != "")), 1, limit))


def project_type(text: Column) -> Column:
    """First project type one of whose words occurs; 'general' otherwise."""
    def pick(t: Column) -> Column:
        out = F.lit("general")
        for label, words in reversed(TYPE_RULES):
            out = F.when(contains_any(t, words), F.lit(label)).otherwise(out)
        return out

    return let(F.lower(F.coalesce(text, F.lit(""))), pick)


def clean_markdown(text: Column) -> Column:
    for pattern, gap in (("(?s)```.*?```", " "), ("`([^`]*)`", "$1"), ("!\\[[^\\]]*\\]\\([^)]*\\)", " "), ("\\[[^\\]]*\\]\\([^)]*\\)", " "), ("(?m)^#+\\s*", "")):
        text = F.regexp_replace(text, pattern, gap)
    return squeeze(text)


def cut(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, with dots when cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("...")))


def project_goal(description: Column, readme: Column) -> Column:
    """Description, else the cleaned readme when it says enough, cut to 220 characters."""
    said = F.nullif(F.trim(F.coalesce(description, F.lit(""))), F.lit(""))
    from_readme = let(clean_markdown(readme), lambda t: F.when(F.length(t) >= 40, cut(t, 220)))
    return F.coalesce(said, from_readme, F.lit(UNCLEAR_GOAL))


def repo_score(df: DataFrame) -> DataFrame:
    """Weighted score; the caller orders by it, descending."""
    has = lambda x: (F.coalesce(c(x), F.lit("")) != "").cast("int")
    yes = lambda x: F.coalesce(c(x), F.lit(False)).cast("int")
    return df.withColumn("resume_score", (
        c("stargazers_count") * 5 + c("forks_count") * 3 + has("homepage") * 12 + yes("is_pinned") * 10 + has("readme") * 8
        + (F.coalesce("sampled_commit_count", F.lit(0)) > 0).cast("int") * 6 + F.least(F.size("stack_signals"), F.lit(5)) * 2 - yes("archived") * 20
    ).cast("long"))


def repo_bullets(df: DataFrame) -> DataFrame:
    """Two or three template sentences per repository; the sentences are fixed values."""
    stack = F.coalesce(F.nullif(F.array_join(F.slice("stack_signals", 1, 5), ", "), F.lit("")), F.lit("public technologies"))
    return df.withColumn("resume_bullets", F.array_compact(F.array(
        F.format_string("Built and maintained a %s project focused on %s.", c("project_type"), F.lower("business_goal")),
        F.format_string("Worked with %s and published the solution as a public GitHub repository.", stack),
        F.when(c("sampled_commit_count") > 0, F.format_string(
            "Shipped at least %d sampled commits with visible public development activity.", c("sampled_commit_count"))),
    )))


def activity_summary(commits: DataFrame, repo: str, ts: str) -> DataFrame:
    """Commits per repository: count, first, last, active days, window in days (at least 1)."""
    days = commits.groupBy(repo, F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    window = F.floor((F.unix_micros(c("last_commit_at").cast("timestamp")) - F.unix_micros(c("first_commit_at").cast("timestamp"))) / F.lit(86_400_000_000))
    return days.groupBy(repo).agg(
        F.sum("_n").alias("sampled_commit_count"), F.min("_lo").alias("first_commit_at"), F.max("_hi").alias("last_commit_at"),
        F.count("_day").alias("active_days"),
    ).withColumn("window_days", F.greatest(window, F.lit(1)))


def merge_skills(frames: Sequence[DataFrame], profile: str, skill: str = "skill", seq: str = "seq") -> DataFrame:
    """Skills of several sources per profile: (profile, skill, position), first spelling kept, sources in the given order."""
    both = None
    for i, df in enumerate(frames):
        part = df.select(profile, F.trim(skill).alias("skill"), F.lit(i).alias("src"), c(seq).alias("seq"))
        both = part if both is None else both.unionByName(part)
    keyed = both.filter("skill <> ''").withColumn("key", F.lower("skill"))
    return keep_first(keyed, [profile, "key"], [F.asc("src"), F.asc("seq")]).select(profile, "skill", "src", "seq")


def best_repos(df: DataFrame, owner: str, n: int) -> DataFrame:
    return head_per_key(df, [owner], [F.desc("resume_score"), F.asc("repo")], n, "repo_no")
