"""Notes, skills and configuration in folders."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip_bytes, flat_body, flat_field

#: Folders that hold no notes, most bytes of a note and notes of a scan.
IGNORED = {".git", ".obsidian", ".trash", ".stfolder", "node_modules", "dist", "build", "vendor", ".venv", "__pycache__", ".cache"}
MAX_BYTES, MAX_NOTES = 2 << 20, 20_000


def scan_notes(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """(ref, size, mtime[, content]) of the Markdown notes below a folder, sorted by path.

    Without content the files aren't opened. Hidden and ignored folders and large
    files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,MD,Markdown}").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + os.path.abspath(root).rstrip("/") + "/", "")
    files = files.withColumn("ref", path).filter(F.col("length") <= MAX_BYTES)
    hidden = F.exists(F.split("ref", "/"), lambda p: F.startswith(p, F.lit(".")) | p.isin(*IGNORED))
    files = files.filter(~hidden).orderBy("ref").limit(MAX_NOTES)
    columns = ["ref", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    return files.select(*columns, *[F.decode("content", "UTF-8").alias("content")] * with_content)


def contained(root: str, relative: str) -> str:
    """Absolute path of a relative one inside ``root``; others are refused."""
    full = os.path.realpath(os.path.join(root, relative))
    if os.path.isabs(relative) or os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise ValueError(f"{relative} is outside of {root}")
    return full


def replace_once(text: str, old: str, new: str) -> str:
    """``text`` with its only occurrence of ``old`` replaced; none or several are refused."""
    if not old or text.count(old) != 1:
        raise ValueError(f"{text.count(old) if old else 0} places match, one is needed")
    return text.replace(old, new)


def merge_config(path: str, changes: dict) -> dict:
    """Write ``changes`` into a JSON file, keeping what else is in it; null removes a key."""
    old = json.load(open(path)) if os.path.exists(path) else {}
    new = {k: v for k, v in (old | changes).items() if v is not None}
    with open(path, "w") as f:
        json.dump(new, f, indent=2, sort_keys=True)
    return new


#: Most bytes of a file that is read whole and of a look at its front matter, a skill's file in a folder of its own, reasoning tokens of a mode.
MAX_READ, PEEK, SKILL_FILE, MODE_TOKENS = 256 << 10, 8 << 10, "SKILL.md", 1024


def read_text(root: str, relative: str) -> str:
    """A file inside ``root``; larger ones are refused."""
    path = contained(root, relative)
    if os.path.getsize(path) > MAX_READ:
        raise ValueError(f"{relative} has more than {MAX_READ} bytes")
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def list_folder(root: str, relative: str = "") -> list[tuple[str, bool, int]]:
    """(name, whether a folder, bytes) of one level, by name."""
    with os.scandir(contained(root, relative)) as entries:
        return sorted((e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in entries)


def write_text(root: str, relative: str, text: str) -> int:
    """Write a file inside ``root``, with the folders on its way; the number of bytes."""
    path = contained(root, relative)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return len(text.encode())


def heads(spark: SparkSession, root: str) -> DataFrame:
    """(ref, text): the first bytes of each note, for a look at its front matter."""
    return scan_notes(spark, root).select("ref", clip_bytes(F.col("content"), PEEK).alias("text"))


def _flat(spark: SparkSession, root: str, depth: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + os.path.abspath(root).rstrip("/") + "/", "")
    rows = files.select(path.alias("ref"), F.decode("content", "UTF-8").alias("text")).filter(F.lower("ref").endswith(".md"))
    return rows.filter(F.size(F.split("ref", "/")) <= depth)


def skills(spark: SparkSession, root: str) -> DataFrame:
    """(name, description, ref, body) of the skills of a folder, by name: files, and folders that hold a skill's file."""
    rows = _flat(spark, root, 2).filter(~F.contains("ref", F.lit("/")) | F.col("ref").endswith("/" + SKILL_FILE))
    own = F.regexp_replace(F.regexp_replace("ref", f"/{SKILL_FILE}$", ""), r"(?i)\.md$", "")
    return rows.select(F.coalesce(flat_field(F.col("text"), "name"), own).alias("name"), F.coalesce(flat_field(F.col("text"), "description"), F.lit("")).alias("description"), "ref", flat_body(F.col("text")).alias("body")).orderBy("name", "ref")


def skill_body(known: DataFrame, name: str) -> DataFrame:
    """The body of the first skill of a name."""
    return known.filter(F.col("name") == name).orderBy("ref").limit(1).select("body")


def save_skill(root: str, name: str, description: str, body: str, replace: bool = False) -> str:
    """Write a skill's file and return its name; one that is there is refused unless it is to be replaced."""
    stem = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-")
    if not stem or not description.strip() or not body.strip():
        raise ValueError("a skill needs a name, a description and a body")
    ref = f"{stem}.md"
    if not replace and (os.path.exists(contained(root, ref)) or os.path.exists(contained(root, f"{stem}/{SKILL_FILE}"))):
        raise ValueError(f"{ref} is there already")
    line = lambda v: " ".join(v.split())
    write_text(root, ref, f"---\nname: {line(name)}\ndescription: {line(description)}\n---\n\n{body.strip()}\n")
    return ref


def modes(spark: SparkSession, root: str) -> DataFrame:
    """(name, max_tokens, prompt) of the reasoning modes of a folder, by name."""
    rows = _flat(spark, root, 1)
    tokens = F.coalesce(F.expr("try_cast(field as int)"), F.lit(MODE_TOKENS))
    return rows.withColumn("field", flat_field(F.col("text"), "max_tokens")).select(F.regexp_replace("ref", r"(?i)\.md$", "").alias("name"), tokens.alias("max_tokens"), flat_body(F.col("text")).alias("prompt")).orderBy("name")
