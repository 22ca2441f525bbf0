"""Project stack detection and user-authored file selection, per repository.

Everything is keyed by ``repo_id``: the manifest table (14 rows) is broadcast,
directory existence is tested only for the handful of candidate source
directories, and per-repository lists are small by construction (manifest
extensions / source dirs, frameworks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strata import schemas as S
from strata.functions.languages import is_binary
from strata.functions.paths import dir_parts, directory_prefixes, file_name, last_suffix

MANIFEST_COLS = "priority int, manifest string, language string, extensions array<string>, src_dirs array<string>"


def manifest_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, lang, exts, dirs) for i, (name, lang, exts, dirs) in enumerate(S.MANIFESTS)]
    return spark.createDataFrame(rows, MANIFEST_COLS)


def _candidate_dirs() -> list[str]:
    seen = []
    for _, _, _, dirs in S.MANIFESTS:
        for d in dirs + S.UNKNOWN_STACK_DIRS:
            if d not in seen:
                seen.append(d)
    return seen


def existing_dirs(files: DataFrame) -> DataFrame:
    """(repo_id, dir) for the candidate source directories that hold at least one file."""
    cands = F.array(*[F.lit(d) for d in _candidate_dirs()])
    hits = F.filter(directory_prefixes("path"), lambda p: F.array_contains(cands, p))
    return files.select("repo_id", F.explode(hits).alias("dir")).distinct()


def _restrict_dirs(stacks: DataFrame, dirs: DataFrame) -> DataFrame:
    """src_dirs -> those that exist (manifest order kept), else all of them."""
    cand = stacks.select("repo_id", F.posexplode("src_dirs").alias("_pos", "dir"))
    exist = cand.join(dirs, ["repo_id", "dir"], "left_semi").groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "dir"))), lambda x: x["dir"]).alias("_exist"))
    out = stacks.join(exist, "repo_id", "left")
    return out.withColumn("existing_dirs", F.coalesce("_exist", F.array().cast("array<string>"))).withColumn(
        "src_dirs", F.when(F.size("existing_dirs") > 0, F.col("existing_dirs")).otherwise(F.col("src_dirs"))).drop("_exist")


def manifest_stack(files: DataFrame) -> DataFrame:
    """Repos with a root-level manifest: the first in priority order wins."""
    mt = manifest_table(files.sparkSession)
    root = files.filter(~F.col("path").contains("/")).select("repo_id", F.col("path").alias("manifest"), "content")
    m = root.join(F.broadcast(mt), "manifest")
    best = m.groupBy("repo_id").agg(F.min_by(F.struct("manifest", "language", "extensions", "src_dirs", "content"),
                                             F.col("priority")).alias("_m"))
    return best.select("repo_id", "_m.*")


def detect_frameworks(stacks: DataFrame) -> DataFrame:
    """Framework names from the winning manifest's content (fixed check order)."""
    content = F.coalesce(F.col("content"), F.lit(""))
    low = F.lower(content)
    deps = F.from_json(content, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    keys = F.array_union(F.coalesce(F.map_keys(deps["dependencies"]), F.array().cast("array<string>")),
                         F.coalesce(F.map_keys(deps["devDependencies"]), F.array().cast("array<string>")))
    js = [F.when(F.array_contains(keys, dep), F.lit(name)) for name, dep in S.JS_FRAMEWORKS]
    py = [F.when(low.contains(pat), F.lit(name)) for name, pat in S.PY_FRAMEWORKS]
    cargo = [F.when(low.contains(pat), F.lit(name)) for pat, name in S.CARGO_FRAMEWORKS]
    go = [F.when(low.contains(pat), F.lit(name)) for pat, name in S.GO_FRAMEWORKS]
    empty = F.array().cast("array<string>")
    fw = (F.when(F.col("manifest") == "package.json", F.array_compact(F.array(*js)))
          .when(F.col("language") == "python", F.array_compact(F.array(*py)))
          .when(F.col("manifest") == "Cargo.toml", F.array_compact(F.array(*cargo)))
          .when(F.col("manifest") == "go.mod", F.array_compact(F.array(*go)))
          .otherwise(empty))
    return stacks.withColumn("frameworks", F.when(F.col("manifest").isNull(), empty).otherwise(fw))


def fallback_stack(files: DataFrame) -> DataFrame:
    """No manifest: the most frequent suffix among files at most three path parts
    deep decides the language (ties: suffix order); no suffix at all -> ``unknown``."""
    spark = files.sparkSession
    ext = last_suffix(file_name("path"))
    shallow = files.filter(F.size(F.split("path", "/")) <= 3).select("repo_id", ext.alias("ext"))
    counted = (shallow.filter((F.col("ext") != "") & ~F.col("ext").isin(*S.IGNORE_EXTENSIONS))
               .groupBy("repo_id", "ext").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("repo_id").orderBy(F.col("n").desc(), F.col("ext"))
    dom = counted.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("repo_id", "ext")
    lang_map = F.create_map(*[x for kv in S.FALLBACK_EXT_LANGUAGE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    repos = files.select("repo_id").distinct()
    base = repos.join(dom, "repo_id", "left").withColumn(
        "language", F.when(F.col("ext").isNull(), F.lit("unknown"))
        .otherwise(F.coalesce(F.element_at(lang_map, F.col("ext")), F.lit("unknown"))))
    # first manifest entry of the same language supplies extensions and source dirs
    firsts = {}
    for _, lang, exts, dirs in S.MANIFESTS:
        firsts.setdefault(lang, (exts, dirs))
    by_lang = spark.createDataFrame([(k, v[0], v[1]) for k, v in firsts.items()],
                                    "language string, m_ext array<string>, m_dirs array<string>")
    j = base.join(F.broadcast(by_lang), "language", "left")
    unknown_exts = F.array(*[F.lit(x) for x in S.UNKNOWN_STACK_EXTENSIONS])
    default_dirs = F.array(*[F.lit(x) for x in S.UNKNOWN_STACK_DIRS])
    return j.select(
        "repo_id", "language", F.lit(None).cast("string").alias("manifest"),
        F.when(F.col("m_ext").isNotNull(), F.col("m_ext"))
         .when(F.col("ext").isNull(), unknown_exts).otherwise(F.array(F.col("ext"))).alias("extensions"),
        F.coalesce(F.col("m_dirs"), default_dirs).alias("src_dirs"),
        F.lit(None).cast("string").alias("content"))


def detect_stack(files: DataFrame) -> DataFrame:
    """Per repo: language, manifest, extensions, source dirs (existing ones, else
    all), frameworks.  Manifest repos first; the rest fall back."""
    ms = manifest_stack(files)
    fb = fallback_stack(files).join(ms.select("repo_id"), "repo_id", "left_anti")
    both = ms.unionByName(fb)
    out = detect_frameworks(_restrict_dirs(both, existing_dirs(files)))
    return out.select("repo_id", "language", "manifest", "extensions", "src_dirs", "existing_dirs", "frameworks")


def authored_files(files: DataFrame, stacks: DataFrame, max_files: int = 80) -> DataFrame:
    """The user-authored files a deep scan would look at, smallest first, ``max_files`` per repo.

    Walk roots are the stack's existing source dirs plus the repository root;
    with source dirs present the root walk reaches one directory down (Q3).
    Ignored directories are pruned below each root; ignored suffixes, names,
    dot-files, empty or > 500,000-byte files and binary files are dropped.
    """
    st = stacks.select("repo_id", "extensions", "existing_dirs")
    j = files.join(st, "repo_id")
    parts = dir_parts("path")
    name = file_name("path")
    depth = F.size(F.split("path", "/"))
    has_roots = F.size("existing_dirs") > 0
    ignored = F.array(*[F.lit(d) for d in S.IGNORE_DIRS])
    # under a source dir: no ignored directory below the root
    under_src = F.exists("existing_dirs", lambda d: F.col("path").startswith(F.concat(d, F.lit("/"))) & ~F.arrays_overlap(
        F.slice(parts, F.size(F.split(d, "/")) + 1, 1 << 16), ignored))
    via_root = F.when(has_roots, depth <= 2).otherwise(F.lit(True)) & ~F.arrays_overlap(parts, ignored)
    ext = last_suffix(name)
    keep = ((under_src | via_root) & ~ext.isin(*S.IGNORE_EXTENSIONS)
            & ((F.size("extensions") == 0) | F.array_contains("extensions", ext))
            & ~name.isin(*S.IGNORE_FILENAMES) & ~name.startswith(".")
            & (F.col("size") > 0) & (F.col("size") <= S.AUTHORED_MAX_BYTES) & ~is_binary("content"))
    cand = j.filter(keep).select("repo_id", "path", "size")
    w = Window.partitionBy("repo_id").orderBy("size", "path")
    return cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= max_files)
