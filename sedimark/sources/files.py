"""File sources: listings, whole texts, binary content, discovery of configuration, change logs and projects.

Everything goes through Spark's readers, so any store that Spark can list works.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that discovery leaves out.
SKIPPED = ("bin", "obj", "node_modules")


def list_files(spark: SparkSession, root: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """path, size, modified of the files under ``root``; names that begin with a dot only if ``hidden``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found if hidden else found.filter(~F.col("path").rlike(r"/\.[^/]*$"))


def read_binary(spark: SparkSession, root: str, pattern: str = "*", largest: int | None = None) -> DataFrame:
    """path, content, size, modified; ``largest`` leaves out bigger files before they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    found = found.filter(F.col("length") <= largest) if largest is not None else found
    return found.select("path", "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_text(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, text of whole files."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def resolve_inputs(spark: SparkSession, patterns: list[str], exclude: str | None = None, largest: int = 10 << 20) -> DataFrame:
    """The files that paths, folders and globs name together, each once, up to ``largest`` bytes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(patterns)
    found = found.filter(F.col("length") <= largest).select("path").distinct()
    return found.filter(~F.col("path").rlike(exclude)) if exclude else found


def discover(listing: DataFrame, extensions: tuple = (".json", ".yml", ".yaml"), skipped: tuple = SKIPPED) -> DataFrame:
    """Files with one of ``extensions`` outside the skipped folders."""
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(list(extensions))
    return listing.filter(ending & ~F.col("path").rlike(f"/({'|'.join(skipped)})/"))


def discover_migrations(listing: DataFrame, folders: tuple = ("Migrations", "Data/Migrations", "Infrastructure/Migrations", "Persistence/Migrations")) -> DataFrame:
    """Code files in the known folders; where these hold none, all code files with names over 15 characters. By path."""
    code = listing.filter(F.col("path").endswith(".cs"))
    known = code.filter(F.col("path").rlike(f"/({'|'.join(folders)})/[^/]*$"))
    named = code.filter(F.length(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.cs$", "")) > 15)
    return (named if known.isEmpty() else known).distinct().orderBy("path")


def project_references(projects: DataFrame) -> DataFrame:
    """(path, target) for every project reference in project files (path, text)."""
    targets = F.regexp_extract_all("text", F.lit('<ProjectReference Include="([^"]+)"'), F.lit(1))
    return projects.select("path", F.explode(targets).alias("target"))


def project_details(projects: DataFrame) -> DataFrame:
    """(path, sdk, output_type, frameworks, packages) of project files (path, text); packages are structs (name, version) by name.

    One or several frameworks may be named. A package's version may stand in an attribute, before or after the name, or in an element; without one it
    is null, as where versions are kept centrally. Comments do not count.
    """
    text = F.regexp_replace("text", "(?s)<!--.*?-->", "")

    def first(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", F.trim(found))

    frameworks = F.filter(F.transform(F.split(first("<TargetFrameworks?>([^<]*)</TargetFrameworks?>"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.regexp_extract_all(text, F.lit(r"(?s)(<PackageReference\s[^>]*?/>|<PackageReference\s.*?</PackageReference>)"), F.lit(1))

    def part(tag: Column, pattern: str) -> Column:
        found = F.regexp_extract(tag, pattern, 1)
        return F.when(found != "", found)

    version = lambda t: F.coalesce(part(t, r'\sVersion="([^"]*)"'), part(t, r"<Version>\s*([^<\s]*)\s*</Version>"))
    packages = F.transform(cut, lambda t: F.struct(part(t, r'\sInclude="([^"]*)"').alias("name"), version(t).alias("version")))
    packages = F.array_sort(F.filter(packages, lambda x: x["name"].isNotNull()))
    none = F.array().cast("array<string>")
    return projects.select("path", first(r'<Project\s[^>]*Sdk="([^"]*)"').alias("sdk"), first("<OutputType>([^<]*)</OutputType>").alias("output_type"), F.coalesce(frameworks, none).alias("frameworks"), packages.alias("packages"))


def framework_usage(details: DataFrame) -> DataFrame:
    """(framework, projects, packages): projects that target each framework and the different packages that these use."""
    each = details.select("path", F.explode("frameworks").alias("framework"), "packages")
    counted = each.groupBy("framework").agg(F.countDistinct("path").alias("projects"))
    used = each.select("framework", F.explode("packages").alias("p")).groupBy("framework").agg(F.countDistinct("p.name").alias("packages"))
    return counted.join(used, "framework", "left").select("framework", "projects", F.coalesce("packages", F.lit(0)).alias("packages"))


def package_conflicts(details: DataFrame) -> DataFrame:
    """(package, versions, projects): packages that projects take in different versions, the versions in order of text."""
    each = details.select("path", F.explode("packages").alias("p")).filter("p.version is not null")
    found = each.groupBy(F.col("p.name").alias("package")).agg(F.array_sort(F.collect_set("p.version")).alias("versions"), F.countDistinct("path").alias("projects"))
    return found.filter(F.size("versions") > 1)


def solution_projects(solutions: DataFrame) -> DataFrame:
    """(path, name, project) of the project lines of solution files (path, text)."""
    line = r'Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+)"'
    hits = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(line), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(line), F.lit(2)).alias("p")))
    return solutions.select("path", hits.alias("x")).select("path", F.col("x.n").alias("name"), F.col("x.p").alias("project"))


def standalone(projects: DataFrame, members: DataFrame) -> DataFrame:
    """Projects (path) that no solution lists."""
    return projects.join(members.select(F.col("project").alias("path")), "path", "left_anti")


def rank_solutions(solutions: DataFrame, root: str, name: str) -> DataFrame:
    """Solutions (path, projects) by score: 100 in the root folder, 50 for the folder's name, one a project."""
    score = F.when(F.regexp_replace("path", "/[^/]*$", "") == root, 100).otherwise(0) + F.when(F.lower(F.element_at(F.split("path", "/"), -1)) == f"{name.lower()}.sln", 50).otherwise(0) + F.col("projects")
    return solutions.withColumn("score", score).orderBy(F.desc("score"), F.length("path"), "path")


_STEP = "struct<name:string,uses:string,run:string>"
WORKFLOW = f"path string, name string, triggers array<string>, env map<string,string>, jobs array<struct<name:string,runs_on:string,steps:array<{_STEP}>>>, secrets array<string>"


def parse_workflows(files: DataFrame) -> DataFrame:
    """Workflow files (path, text) as path, name, triggers, env, jobs, secrets; files that are no YAML map are left out.

    ``on`` may be a string, a list or a map. A step without a name takes that of what it uses or runs.
    """
    import re

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
        step = pa.struct([(c, pa.string()) for c in ("name", "uses", "run")])
        kinds += [pa.list_(pa.struct([("name", pa.string()), ("runs_on", pa.string()), ("steps", pa.list_(step))])), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for path, text in zip(b["path"].to_pylist(), b["text"].to_pylist()):
                try:
                    doc = yaml.load(text or "", Loader=loader)
                except yaml.YAMLError:
                    continue
                if not isinstance(doc, dict):
                    continue
                on = doc.get("on", doc.get(True))  # YAML 1.1 reads the key on as true
                triggers = [on] if isinstance(on, str) else [str(x) for x in on or ()]
                jobs = []
                for key, job in (doc.get("jobs") or {}).items():
                    steps = [
                        {"name": s.get("name") or s.get("uses") or s.get("run"), "uses": s.get("uses"), "run": s.get("run")}
                        for s in (job or {}).get("steps") or ()
                    ]
                    jobs.append({"name": str(key), "runs_on": str((job or {}).get("runs-on", "ubuntu-latest")), "steps": steps})
                env = [(str(k), str(v)) for k, v in (doc.get("env") or {}).items()]
                secrets = list(dict.fromkeys(re.findall(r"secrets\.(\w+)", text)))
                rows.append((path, doc.get("name"), triggers, env, jobs, secrets))
            names = ["path", "name", "triggers", "env", "jobs", "secrets"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return files.select("path", "text").mapInArrow(parse, WORKFLOW)


def workflow_issues(workflows: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, job, version, framework) where a job sets up another SDK version than a project (path, framework) needs."""
    jobs = workflows.select("path", F.explode("jobs").alias("j"))
    runs = jobs.select("path", F.col("j.name").alias("job"), F.explode(F.transform("j.steps", lambda s: F.concat_ws(" ", s["name"], s["uses"], s["run"]))).alias("step"))
    versions = runs.select("path", "job", F.regexp_extract("step", r"(\d+)\.0", 1).alias("version")).filter("version <> ''").distinct()
    needed = projects.select("framework", F.regexp_extract("framework", r"net(\d+)", 1).alias("needed")).distinct()
    return versions.join(F.broadcast(needed), F.col("version") != F.col("needed")).select("path", "job", "version", "framework")
