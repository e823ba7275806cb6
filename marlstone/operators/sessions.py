"""Session state: plans, tools, skills, titles, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a plan's steps, most steps, longest title.
STATES, MAX_STEPS, MAX_TITLE = ("pending", "in_progress", "completed", "failed"), 200, 40
#: Content types of artifacts by file ending.
TYPES = {
    "md": "markdown", "markdown": "markdown", "py": "python", "go": "go", "js": "javascript", "ts": "typescript", "json": "json",
    "yaml": "yaml", "yml": "yaml", "html": "html", "htm": "html", "css": "css", "sql": "sql", "txt": "text",
}


def plan_faults(steps: DataFrame) -> DataFrame:
    """(session_id, fault) of plans (session_id, seq, content, status) that can't be saved."""
    of = steps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("status") == "in_progress").cast("int")).alias("busy"),
        F.max((~F.coalesce(F.col("status").isin(*STATES), F.lit(False))).cast("int")).alias("odd"),
        F.max((F.trim(F.coalesce("content", F.lit(""))) == "").cast("int")).alias("blank"),
    )
    fault = F.when(F.col("n") > MAX_STEPS, "too many steps").when(F.col("odd") == 1, "unknown status").when(F.col("blank") == 1, "empty step").when(F.col("busy") > 1, "several steps in progress")
    return of.select("session_id", fault.alias("fault")).filter("fault is not null")


def current_step(steps: DataFrame) -> DataFrame:
    """The step in progress, else the first that is pending, of each plan."""
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1)
    open_ = steps.withColumn("rank", rank).filter("rank is not null")
    return open_.groupBy("session_id").agg(F.min_by(F.struct("seq", "content"), F.struct("rank", "seq")).alias("s")).select("session_id", "s.seq", "s.content")


def replace_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """Plans of the sessions in ``new`` are replaced whole."""
    return old.join(new.select("session_id").distinct(), "session_id", "left_anti").unionByName(new)


def enabled_tools(tools: DataFrame, disabled: DataFrame, session_id: object) -> DataFrame:
    """Tools that a session hasn't switched off, by name."""
    off = disabled.filter(F.col("session_id") == session_id).select(F.col("tool_name").alias("name"))
    return tools.join(off, "name", "left_anti").orderBy("name")


def find_skills(skills: DataFrame, keyword: str) -> DataFrame:
    """Skills whose name or description holds the keyword, whatever the case."""
    text = F.lower(F.concat_ws(" ", "name", "description"))
    return skills.filter(F.contains(text, F.lower(F.lit(keyword)))).orderBy("name")


def title_of(message: Column) -> Column:
    """A title from a first message: white space collapsed, cut at a word after 40 characters."""
    x = F.trim(F.regexp_replace(message, r"\s+", " "))
    short = F.regexp_replace(F.substring(x, 1, MAX_TITLE), r" [^ ]*$", "")
    return F.when(x == "", "New Chat").when(F.length(x) > MAX_TITLE, F.concat(short, F.lit("…"))).otherwise(x)


def artifact_type(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(kinds[ending], F.lit("text"))


def safe_name(title: Column) -> Column:
    """A file name from a title: characters that a file system may refuse become one underscore."""
    x = F.regexp_replace(F.trim(title), r'[\\/:*?"<>|]+', "_")
    return F.when(F.coalesce(x, F.lit("")) == "", "artifact").otherwise(x)


def export_name(title: Column, content_type: Column) -> Column:
    """The name of the file that an artifact is exported to; a type without an ending of its own gives ``txt``."""
    first = {kind: ending for ending, kind in reversed(TYPES.items())}
    endings = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.concat(safe_name(title), F.lit("."), F.coalesce(endings[F.coalesce(content_type, F.lit(""))], F.lit("txt")))


def latest_session(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def with_sequence(old: DataFrame, new: DataFrame) -> DataFrame:
    """New messages (session_id, pos, …) numbered on from what each session has."""
    top = old.groupBy("session_id").agg(F.max("seq").alias("top"))
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("pos"))
    return new.withColumn("n", number).join(top, "session_id", "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.col("n")).drop("n", "top", "pos")
