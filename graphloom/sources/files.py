"""Files as rows: scanning, ignoring, guards, dispatch by ending (SRC1-SRC4, SRC16, SRC21, ETL14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never scanned, unless the caller says otherwise.
IGNORED = tuple(
    (
        "node_modules vendor bower_components jspm_packages web_modules .git .svn .hg dist build target out _build coverage .nyc_output .cache .turbo .next .nuxt .output .svelte-kit .astro .parcel-cache "
        ".vite __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox .npm .yarn .pnpm-store .pub-cache .dart_tool .bundle ios/Pods Pods Carthage .vercel .netlify .firebase .idea .vscode .venv venv "
        "third_party third-party vendored"
    ).split()
)
# The file that marks a folder as an installed environment.
ENVIRONMENT_MARK = "pyvenv.cfg"
# Limits of the guard against generated files.
MOST_BYTES, LONGEST_LINE, PROBE_BYTES = 1_500_000, 5_000, 8_192
# Languages by file ending; compound endings come first.
LANGUAGES = ((".blade.php", "blade"), (".php", "php"), (".py", "python"), (".tsx", "typescript"), (".ts", "typescript"), (".jsx", "javascript"), (".js", "javascript"), (".go", "go"), (".dart", "dart"))


def scan(spark: SparkSession, root: str | Sequence[str], ignored: Sequence[str] = IGNORED, endings: Sequence[str] | None = None) -> DataFrame:
    """SRC1: (path, content, size) of text files below one root or several, each file once.

    Paths are listed first, without content; folders that are ignored and folders of installed
    environments are dropped there, and only the files that are left are read.  A root that cannot
    be read is an error.
    """
    roots = [root] if isinstance(root, str) else list(root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    listed = raw.select("path", F.col("length").alias("size"))  # the content is not among the columns, so it isn't read
    below = F.col("path")
    for r in roots:
        below = F.substring_index(below, r.split("://")[-1].rstrip("/") + "/", -1)
    kept = listed.withColumn("below", below).where(~is_ignored(F.col("below"), ignored))
    name = F.substring_index("path", "/", -1)
    marks = listed.where(name == ENVIRONMENT_MARK).select(F.substring("path", 1, F.length("path") - len(ENVIRONMENT_MARK) - 1).alias("folder"))
    parts = F.split("path", "/")
    above = kept.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    kept = kept.join(above.join(marks, "folder", "left_semi").select("path"), "path", "left_anti")
    if endings is not None:
        kept = kept.where(F.lower(F.substring_index("path", ".", -1)).isin(*[e.lower().lstrip(".") for e in endings]))
    wanted = [r["path"] for r in kept.select("path").distinct().collect()]  # names of files only, which the reader's own listing has on the driver too
    if not wanted:
        return spark.createDataFrame([], "path string, content string, size long")
    read = spark.read.format("binaryFile").load([w.replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for w in wanted])
    return read.select("path", F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def is_ignored(path: Column, ignored: Sequence[str] = IGNORED) -> Column:
    """SRC2: the path is one of the folders, below one, or holds one."""
    test = F.lit(False)
    for d in ignored:
        test = test | (path == d) | path.startswith(f"{d}/") | path.contains(f"/{d}/") | path.endswith(f"/{d}")
    return test


def is_generated(path: Column, content: Column, size: Column) -> Column:
    """SRC3: minified or bundled by name, too large, or with a very long line in its first part (counted in characters)."""
    named = F.lower(path).rlike(r"\.(min|bundle|pack)\.(js|ts|css)$")
    lines = F.split(F.substring(content, 1, PROBE_BYTES), "\n")
    return named | (size > MOST_BYTES) | F.exists(lines, lambda x: F.length(x) > LONGEST_LINE)


def language(path: Column) -> Column:
    """SRC4: null for unknown endings."""
    p = F.lower(path)
    return F.coalesce(*(F.when(p.endswith(e), name) for e, name in LANGUAGES))


def inventory(files: DataFrame) -> DataFrame:
    """SRC21: (path, kind) by file name."""
    name = F.lower(F.substring_index("path", "/", -1))
    kinds = (
        ("container", r"^(dockerfile.*|docker-compose.*\.ya?ml|compose\.ya?ml)$"), ("proxy", r"^(caddyfile|nginx\.conf|httpd\.conf|\.htaccess)$"), ("manifest", r"^(composer|package)\.json$|^(pyproject\.toml|requirements.*\.txt|go\.mod|pubspec\.yaml)$"),
        ("environment", r"^\.env"), ("unit", r"\.(service|timer)$"), ("script", r"\.(sh|bash)$"), ("crawl", r"^(robots\.txt|sitemap.*\.xml)$"), ("contract", r"^(openapi|swagger).*\.(json|ya?ml)$"), ("readme", r"^readme"),
    )
    return files.select("path", F.coalesce(*(F.when(name.rlike(p), k) for k, p in kinds), F.lit("other")).alias("kind"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: services (name, root, hostnames, seq) of a JSON catalogue."""
    shape = "services array<struct<name:string,path:string,hostnames:array<string>>>"
    raw = spark.read.option("multiLine", True).schema(shape).json(path)
    return raw.select(F.posexplode("services").alias("seq", "s")).select("s.name", F.col("s.path").alias("root"), F.coalesce("s.hostnames", F.array().cast("array<string>")).alias("hostnames"), "seq")


def advice(graph_size: int) -> dict[str, bool]:
    """ETL14: what a single machine would have left out at this number of nodes; nothing is left out here."""
    return {"cycles_were_skipped_above_20000": graph_size > 20_000, "architecture_was_skipped_above_5000": graph_size > 5_000}


# Files that tell a bundled library, and what its folders are called.
LIBRARY_MARKS = ("composer.json", "package.json", "bower.json")
LIBRARY_FOLDERS = ("lib", "libs", "library", "libraries", "plugins", "packages", "external", "contrib", "assets")


def bundled_libraries(files: DataFrame, most_depth: int = 3) -> DataFrame:
    """SRC24: (folder, mark) of folders at most ``most_depth`` below the root that hold a manifest inside a folder for libraries."""
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.substring_index("path", "/", -1)
    rows = files.select(folder.alias("folder"), name.alias("mark")).where(F.col("mark").isin(*LIBRARY_MARKS) & (F.col("folder") != ""))
    segments = F.split("folder", "/")
    inside = F.exists(F.slice(segments, 1, F.size(segments) - 1), lambda x: F.lower(x).isin(*LIBRARY_FOLDERS))
    return rows.where((F.size(segments) <= most_depth) & inside).groupBy("folder").agg(F.min("mark").alias("mark"))
