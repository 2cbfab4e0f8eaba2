"""Sources that regular expressions can read, as built-in functions over file rows (SRC10-SRC15, SRC19, SRC20, BG5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalar import entropy, strip_comments, url_kind, url_parts
from graphloom.sources.php_routes import routes, script_calls  # noqa: F401


def matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches as an array of arrays of groups; a group that takes no part is empty."""
    lists = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in range(1, groups + 1)]
    return F.transform(F.sequence(F.lit(1), F.size(lists[0])), lambda i: F.array(*(F.element_at(x, i.cast("int")) for x in lists))) if groups else F.array()


def _found(df: DataFrame, text: str, pattern: str, groups: int) -> DataFrame:
    """A row for each match, with its groups in m."""
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(1, groups + 1)])
    return df.where(F.size(first) > 0).select("*", F.posexplode(zipped).alias("n", "z")).select(*df.columns, "n", F.array(*(F.col(f"z.g{k}") for k in range(1, groups + 1))).alias("m"))


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text)"""
    return files.select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("k", "text")).select("path", (F.col("k") + 1).alias("line"), "text")


def blade_edges(files: DataFrame, namespace: str = "App\\Http\\Livewire") -> DataFrame:
    """SRC10: edges from a component's view to the methods that it triggers, each once."""
    name = F.regexp_extract("path", r"livewire/(.+)\.blade\.php$", 1)
    studly = F.array_join(F.transform(F.split(name, "/"), lambda p: F.array_join(F.transform(F.split(p, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, F.length(w)))), "")), "\\")
    own = files.where(name != "").withColumn("target", F.concat(F.lit(namespace + "\\"), studly))
    found = _found(own, "content", r"wire:(?:click|submit\.prevent|submit|keydown\.enter|change)\s*=\s*[\"']([a-zA-Z_]\w*)(?:\([^)]*\))?[\"']", 1)
    return found.select(F.concat(F.lit("blade:"), "path").alias("src"), F.concat("target", F.lit("::"), F.col("m")[0]).alias("dst"), F.col("m")[0].alias("method"), F.lit("wire_action").alias("type")).distinct()


def url_calls(files: DataFrame, style: str = "c") -> DataFrame:
    """SRC12: every URL literal outside comments: (path, line, url, scheme, host, port, url_path, query, kind)."""
    plain = files.select("path", strip_comments(F.col("content"), style).alias("content"))
    found = _found(lines(plain), "text", r"(https?://[^\s'\"<>]+)", 1).withColumn("url", F.col("m")[0]).withColumn("u", url_parts(F.col("url")))
    return found.select("path", "line", "url", "u.scheme", "u.host", "u.port", F.col("u.path").alias("url_path"), "u.query", url_kind(F.col("u.host"), F.col("u.path")).alias("kind"))


# Parts of a key whose value is never read.
SECRET_KEYS = "password|passwd|secret|token|api_key|apikey|private|credential"


def config_urls(files: DataFrame) -> DataFrame:
    """SRC13: URLs of example environment and ini files: (path, line, key, scheme, host, port, commented); keys of secrets are left out."""
    own = lines(files.where(F.lower(F.substring_index("path", "/", -1)).rlike(r"^\.env\.(example|dist|sample)$|\.ini$")))
    pattern = r"^\s*(#?)\s*([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*[\"']?(https?://[^\s\"'#]+)"
    row = own.select("path", "line", F.regexp_extract("text", pattern, 1).alias("c"), F.regexp_extract("text", pattern, 2).alias("key"), url_parts(F.regexp_extract("text", pattern, 3)).alias("u"))
    env = F.substring_index("path", "/", -1).startswith(".env")
    return row.where("key <> ''").where(~F.lower("key").rlike(SECRET_KEYS)).select("path", "line", "key", "u.scheme", "u.host", "u.port", (env & (F.col("c") == "#")).alias("commented"))


# Operations of a contract.
OPERATIONS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")


def openapi(files: DataFrame) -> DataFrame:
    """SRC15: operations of JSON contracts: (path, method, endpoint, summary)."""
    shape = "struct<paths:map<string,map<string,struct<summary:string,description:string,operationId:string>>>>"
    paths = files.select("path", F.explode(F.from_json("content", shape)["paths"]).alias("endpoint", "ops"))
    ops = paths.select("path", "endpoint", F.explode("ops").alias("verb", "op")).where(F.lower("verb").isin(*OPERATIONS))
    return ops.select("path", F.upper("verb").alias("method"), "endpoint", F.coalesce("op.summary", "op.description", "op.operationId", F.lit("")).alias("summary"))


def unit_files(files: DataFrame) -> DataFrame:
    """SRC19: what service and timer units start and when: (path, key, value)."""
    found = _found(files.select("path", "content"), "content", r"(?m)^(ExecStart|OnCalendar|WorkingDirectory|EnvironmentFile)\s*=\s*(.+?)\s*$", 2)
    return found.select("path", F.col("m")[0].alias("key"), F.col("m")[1].alias("value"))


def robots(files: DataFrame) -> DataFrame:
    """SRC20: rules of robots.txt: (path, agent, rule, value, seq); a group's agents precede its rules."""
    row = lines(files).select("path", "line", F.lower(F.regexp_extract("text", r"^\s*([A-Za-z-]+)\s*:", 1)).alias("rule"), F.trim(F.regexp_extract("text", r"^\s*[A-Za-z-]+\s*:\s*([^#]*)", 1)).alias("value")).where("rule <> ''")
    from pyspark.sql import Window

    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("rule") == "user-agent", F.col("value")), ignorenulls=True).over(before)
    return row.withColumn("agent", agent).where("rule <> 'user-agent'").select("path", F.coalesce("agent", F.lit("*")).alias("agent"), "rule", "value", F.col("line").alias("seq"))


def page_rules(pages: DataFrame) -> DataFrame:
    """SRC20: canonical link and robots rule of every page: (page_id, canonical, robots); attributes may come in any order."""
    tag = lambda p: F.regexp_extract("html", p, 0)
    link, meta = tag(r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical)[^>]*>"), tag(r"(?is)<meta\b(?=[^>]*\bname\s*=\s*[\"']?robots)[^>]*>")
    value = lambda t, a: F.nullif(F.regexp_extract(t, rf"(?is)\b{a}\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    return pages.select("page_id", value(link, "href").alias("canonical"), value(meta, "content").alias("robots"))


def page_links(pages: DataFrame) -> DataFrame:
    """SRC20: every link of a page: (page_id, href), in either kind of quotes."""
    pattern = F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*(\"[^\"]*\"|'[^']*')")
    quoted = pages.select("page_id", F.explode(F.regexp_extract_all("html", pattern, 1)).alias("q"))
    return quoted.select("page_id", F.expr("substring(q, 2, length(q) - 2)").alias("href"))


def sitemap(files: DataFrame) -> DataFrame:
    """SRC20: addresses of sitemaps: (path, loc, kind, seq); kind is url or sitemap."""
    found = _found(files.select("path", "content"), "content", r"(?is)<(url|sitemap)\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>", 2)
    return found.select("path", F.col("m")[1].alias("loc"), F.lower(F.col("m")[0]).alias("kind"), F.col("n").alias("seq"))


# Known forms of credentials, with names of variables that hold some.
CREDENTIALS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"sk-[a-z]{3}-[a-zA-Z0-9]", r"sk-[a-zA-Z0-9]{48}", r"ghp_[a-zA-Z0-9]{36}")
CREDENTIAL_NAMES = "password|secret|key|token|api_key|apikey|passwd|pwd|credential"


def credentials(files: DataFrame, least_bits: float = 4.5, least_length: int = 16) -> DataFrame:
    """BG5: string literals that are credentials by form, or by their variable's name and their entropy: (path, line, name, confidence)."""
    found = _found(lines(files), "text", r"\$?([A-Za-z_]\w*)\s*=\s*(?:'([^']*)'|\"([^\"]*)\")", 3)
    value = F.concat(F.col("m")[1], F.col("m")[2])
    row = found.select("path", "line", F.col("m")[0].alias("name"), value.alias("v"))
    known = F.lit(False)
    for p in CREDENTIALS:
        known = known | F.col("v").rlike(f"^{p}")
    likely = F.lower("name").rlike(CREDENTIAL_NAMES) & (F.length("v") >= least_length) & (entropy(F.col("v")) > least_bits)
    return row.withColumn("confidence", F.when(known, 0.95).when(likely, 0.8)).where("confidence is not null").select("path", "line", "name", "confidence")
