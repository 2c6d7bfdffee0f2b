"""Experience: keys, patterns of fixes, retrieval and warnings.

An experience has id, type, file, action, fixer, success, confidence,
code_before, code_after, error and ord.
"""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values as V
from ..functions import scalars as S
from .syntax import parse


def file_pattern(path: Column) -> Column:
    """The last three parts of a path, the last of them a star and the suffix (a star without one)."""
    parts = F.split(path, "/")
    suffix = F.coalesce(F.nullif(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1), F.lit("")), F.lit("*"))
    folder = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.least(F.size(parts), F.lit(3)) - 1)
    return F.when(path.isNotNull(), F.concat(F.when(F.size(folder) > 0, F.concat(F.array_join(folder, "/"), F.lit("/"))).otherwise(""), F.lit("*"), suffix))


def common_folder(paths: Column) -> Column:
    """Of an array of paths the folder of the one with the fewest parts, with a star; a star alone at the root."""
    parts = F.transform(F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != ""), lambda p: F.struct(F.size(F.split(p, "/")).alias("n"), p.alias("p")))
    path = F.array_min(parts)["p"]
    return F.coalesce(F.when(F.contains(path, F.lit("/")), F.concat(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("/*"))), F.lit("*"))


def experience_id(kind: Column, file: Column, action: Column, at: Column) -> Column:
    """Ten digits that stand for type, file, action and hour; equal within the hour."""
    return F.left(F.md5(F.concat_ws(":", kind, file, action, F.date_format(at, "yyyyMMddHH"))), F.lit(10))


def cache_key(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("::"), prompt), 256)


def action_key(action: Column) -> Column:
    """An action without paths, line numbers and long names, 200 characters at most."""
    x = F.regexp_replace(action, r"[\\/][\p{L}\p{N}_./\\]+\.[\p{L}\p{N}_]+", "<FILE>")
    x = F.regexp_replace(F.regexp_replace(x, r"line \d+", "line N"), r"\b[a-z_][a-zA-Z0-9_]{20,}\b", "<LONG_NAME>")
    return F.left(x, F.lit(200))


def fix_patterns(experience: DataFrame) -> DataFrame:
    """Patterns of successful fixes of confidence 0.5 or more, by type and code (its first 100 characters) or, without code, action.

    A pattern has its number of successes, their mean confidence, the last
    fixer and action, the longest code (the first of equals) with what became of it,
    and the folder of its files; ``place`` orders those of a type by successes and confidence.
    """
    x = experience.where(F.col("success") & (F.col("confidence") >= 0.5) & (F.coalesce("type", F.lit("")) != "") & (F.coalesce("action", F.lit("")) != ""))
    code = F.coalesce("code_before", F.lit(""))
    x = x.withColumn("pattern", F.when(code != "", F.concat(F.lit("__code__"), F.left(code, F.lit(100)))).otherwise(action_key(F.col("action"))))
    longest = F.max_by(F.struct(code.alias("code_before"), F.coalesce("code_after", F.lit("")).alias("code_after")), F.struct(F.length(code), -F.col("ord")))
    x = x.groupBy("type", "pattern").agg(F.count("*").alias("successes"), F.avg("confidence").alias("mean_confidence"), F.max_by(F.struct("fixer", "action"), "ord").alias("last"), longest.alias("code"), common_folder(F.collect_set("file")).alias("files"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("successes"), F.desc("mean_confidence"), "first"))
    return x.select("type", "pattern", "successes", "mean_confidence", F.coalesce("last.fixer", F.lit("unknown")).alias("fixer"), "last.action", "code.code_before", "code.code_after", "files", place.alias("place"))


def path_share(pattern: Column, file: Column) -> Column:
    """1 for files of a folder of the same name, 0.5 for a pattern that ends in the file's suffix, else 0.1."""
    part = lambda p, n: F.try_element_at(F.split(p, "/"), F.lit(n))
    suffix = F.substring_index(part(file, -1), ".", -1)
    return F.when(part(pattern, -2) == part(file, -2), 1.0).when(F.contains(part(file, -1), F.lit(".")) & F.endswith(part(pattern, -1), suffix), 0.5).otherwise(0.1)


def best_patterns(issues: DataFrame, patterns: DataFrame, least: float = 0.3) -> DataFrame:
    """For each issue (id, type, file, description) the pattern of its type of the highest score, of equals the first: 0.4 path and 0.6 words shared, ``least`` (0.3 or more) at least.

    Not all patterns of a type are paired with its issues. What reaches 0.3 is of a
    folder of the same name, and then the first such pattern or one that shares a
    word; or a sixth of all its words are shared, and then one of its rarest: all but as
    many as must be shared, less one.
    """
    folder = lambda p: F.try_element_at(F.split(p, "/"), F.lit(-2))
    p = patterns.select("type", "pattern", "files", F.col("place").alias("p_place"), S.tokens(F.coalesce("code_before", F.lit(""))).alias("p_words"), folder(F.col("files")).alias("folder"))
    x = issues.select("id", "type", "file", S.tokens(F.coalesce("description", F.lit(""))).alias("words"), folder(F.col("file")).alias("folder"))
    spelt = x.select("id", "type", "folder", F.explode("words").alias("t"))
    posts = p.select("type", "pattern", "folder", F.size("p_words").alias("n"), F.explode("p_words").alias("t"))
    first = p.where("folder IS NOT NULL").groupBy("type", "folder").agg(F.min_by("pattern", "p_place").alias("pattern"))
    often = posts.groupBy("type", "t").agg(F.count("*").alias("f"))
    ranked = posts.join(often, ["type", "t"]).groupBy("type", "pattern").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"), F.first("n").alias("n"))
    rare = ranked.select("type", "pattern", F.explode(F.slice(F.col("ts.t"), F.lit(1), (F.col("n") - F.ceil(F.col("n") / 6) + 1).cast("int"))).alias("t"))
    pair = lambda a, b, on: a.join(b, on).select("id", "type", "pattern")
    pairs = pair(x, first, ["type", "folder"]).union(pair(spelt, posts, ["type", "folder", "t"])).union(pair(spelt, rare, ["type", "t"])).distinct()
    x = pairs.join(x.drop("type", "folder"), "id").join(p.drop("folder"), ["type", "pattern"])
    shared = F.size(F.array_intersect("words", "p_words"))
    code = F.when((F.size("words") > 0) & (F.size("p_words") > 0), shared / (F.size("words") + F.size("p_words") - shared)).otherwise(0.0)
    x = x.withColumn("score", 0.4 * path_share(F.col("files"), F.col("file")) + 0.6 * code)
    x = x.groupBy("id").agg(F.max_by(F.struct("pattern", "score"), F.struct("score", -F.col("p_place"))).alias("b"))
    return x.select("id", "b.pattern", "b.score").where(F.col("score") >= max(least, 0.3))


def apply_patterns(files: DataFrame) -> DataFrame:
    """Files (file, text, code_before, code_after) with the first occurrence replaced, where the result still parses; else as they were, and whether it was done."""
    known = (F.coalesce("code_before", F.lit("")) != "") & (F.coalesce("code_after", F.lit("")) != "")
    at = F.when(known, F.position(F.col("code_before"), F.col("text"))).otherwise(0)
    x = files.withColumn("new", F.when(at > 0, F.concat(F.left("text", at - 1), F.col("code_after"), F.substring(F.col("text"), at + F.length("code_before"), F.length("text")))))

    @F.pandas_udf("boolean")
    def parses(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and parse(t) is not None)

    ok = F.coalesce(F.col("new").isNotNull() & parses("new"), F.lit(False))
    return x.withColumn("applied", ok).select("file", F.when(F.col("applied"), F.col("new")).otherwise(F.col("text")).alias("text"), "applied")


def overview(experience: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Number of experiences, patterns and suggestions (three successes or more)."""
    x = experience.groupBy(*keys, "type", "fixer").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"))
    return x.groupBy(*keys).agg(F.sum("n").alias("experiences"), F.count("*").alias("patterns"), F.count_if(F.col("ok") >= 3).alias("suggestions"))


def top_patterns(experience: DataFrame, most: int = 10) -> DataFrame:
    """The patterns (type, fixer) of the highest rate of success, of equals the first seen."""
    x = experience.groupBy("type", "fixer").agg(F.count("*").alias("total"), F.count_if("success").alias("ok"), F.avg("confidence").alias("c"), F.min("ord").alias("first"))
    x = x.orderBy(F.desc(F.col("ok") / F.col("total")), "first").limit(most)
    return x.select("type", "fixer", F.bround(F.col("ok") / F.col("total"), 3).alias("success_rate"), "total", F.bround("c", 3).alias("mean_confidence"))


def prompt_stats(experience: DataFrame, last: int = 50) -> DataFrame:
    """Of the last records of each type: successes, number, mean confidence, and the last five actions that failed."""
    n = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ord")))
    x = experience.withColumn("_n", n).where(F.col("_n") <= last)
    failed = F.array_sort(F.collect_list(F.when(~F.col("success"), F.struct(F.col("_n"), "action"))))
    x = x.groupBy("type").agg(F.count_if("success").alias("successes"), F.count("*").alias("total"), F.bround(F.avg("confidence"), 6).alias("mean_confidence"), failed.alias("f"))
    return x.select("type", "successes", "total", "mean_confidence", F.reverse(F.slice(F.col("f.action"), 1, 5)).alias("failed_actions"))


def failure_warnings(experience: DataFrame, most: int = 5) -> DataFrame:
    """(type, place, warning): the first failures of each type that differ in their error."""
    x = experience.where(~F.col("success") & (F.coalesce("error", F.lit("")) != "")).groupBy("type", "error").agg(F.min_by(F.struct("ord", "file", "line"), "ord").alias("e"))
    x = x.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy("e.ord"))).where(F.col("place") <= most)
    text = F.concat(F.lit("在 "), F.coalesce("e.file", F.lit("?")), F.lit(":"), F.coalesce(F.col("e.line").cast("string"), F.lit("?")), F.lit(" 修复失败: "), F.left("error", F.lit(100)))
    return x.select("type", "place", text.alias("warning"))


def by_ids(experience: DataFrame, ids: DataFrame) -> DataFrame:
    """The first experience of each wanted id (column id of ``ids``); unknown ids drop out."""
    x = experience.join(ids.select("id").distinct(), "id", "left_semi")
    return x.groupBy("id").agg(F.min_by(F.struct(*(c for c in x.columns if c != "id")), "ord").alias("e")).select("id", "e.*")


def propagated(calibration: DataFrame, least: int = 3) -> DataFrame:
    """(type, fixers): calibrated confidence by fixer, of those with enough samples."""
    return calibration.where(F.col("samples") >= least).groupBy("type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fixer", "calibrated")))).alias("fixers"))


def feature(code: Column) -> Column:
    """The first line with code, 120 characters at most."""
    lines = F.filter(F.transform(F.split(F.coalesce(code, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")) & ~F.startswith(x, F.lit('"""')))
    return F.left(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.lit(120))


def description() -> Column:
    """The sentence by which an experience (its columns) is found."""
    kind, code = F.col("type"), feature(F.col("code_before"))
    has = lambda *words: F.greatest(F.lit(False), *(F.contains(code, F.lit(w)) for w in words))
    plain = F.concat(F.lit("代码上下文: "), code, F.lit("。"))
    told = lambda lead: F.concat(F.lit(lead + "语句: "), code, F.lit("。"))
    outcome = F.concat(F.lit("修复结果: "), F.when(F.coalesce("success", F.lit(True)), "成功").otherwise("失败"))
    fix = F.concat(F.lit("修复方法: "), F.coalesce("action", F.lit("")), F.lit("。"))
    middle = (
        F.when(kind == "sql_injection", F.when(has("f-string", "f'", 'f"'), told("代码通过 f-string 拼接 SQL 查询。")).when(has("execute(") & has("+", "%", ".format"), told("代码通过拼接方式构造 execute() 参数。")).otherwise(plain))
        .when(kind == "command_injection", F.when(has("os.system", "os.popen"), told("使用 os.system/os.popen 直接执行命令。")).when(has("subprocess") & has("shell=True"), told("使用 subprocess 但启用 shell=True。")).otherwise(plain))
        .when(kind == "ssrf_vulnerability", F.when(has("requests", "httpx", "urllib"), told("代码使用网络请求库直接访问用户输入的 URL。")).otherwise(plain))
    )
    for name, lead in V.DESCRIPTIONS.items():
        middle = middle.when(kind == name, told(lead))
    named = F.coalesce(kind.isin(*V.DESCRIPTIONS, "sql_injection", "command_injection", "ssrf_vulnerability"), F.lit(False))
    middle = middle.otherwise(F.when(code != "", plain).otherwise(""))
    tool = F.when(~named & (F.coalesce("fixer", F.lit("")) != ""), F.concat(F.lit("修复工具: "), F.col("fixer"), F.lit("。"))).otherwise("")
    why = F.when(~named & ~F.coalesce("success", F.lit(True)) & (F.coalesce("error", F.lit("")) != ""), F.concat(F.lit("失败原因: "), F.left("error", F.lit(100)))).otherwise("")
    return F.concat(F.lit("问题类型: "), F.coalesce(kind, F.lit("unknown")), F.lit("。"), middle, fix, tool, outcome, why)


def index_additions(source: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``source`` to append to an index that lacks their ids; the whole of it where the index is empty."""
    return source.join(index.select("id").distinct(), "id", "left_anti")


def index_state(source: DataFrame, index: DataFrame) -> DataFrame:
    """One row: size of the index, of the source, and whether the index is empty or older than the source (column at)."""
    a = index.agg(F.count("*").alias("indexed"), F.max("at").alias("built"))
    b = source.agg(F.count("*").alias("known"), F.max("at").alias("changed"))
    return a.withColumn("_k", F.lit(0)).join(b.withColumn("_k", F.lit(0)), "_k").select("indexed", "known", ((F.col("indexed") == 0) | F.coalesce(F.col("changed") > F.col("built"), F.lit(False))).alias("dirty"))


def found_or_recent(wanted: DataFrame, found: DataFrame, experience: DataFrame, last: int = 20) -> DataFrame:
    """(query, id, score): what the search found for each query (query, type), or else the last experiences of exactly its type."""
    n = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ord")))
    recent = experience.withColumn("_n", n).where(F.col("_n") <= last).select("type", "id")
    rest = wanted.join(found.select("query").distinct(), "query", "left_anti").join(recent, "type").select("query", "id", F.lit(None).cast("double").alias("score"))
    return found.select("query", "id", "score").unionByName(rest)


def most_similar(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """(doc_id, item_id, score): the item of the highest share of common words, of equals the smallest, if ``least`` or more.

    A pair that reaches ``least`` shares one of the rarest words of its item (all
    but as many as it must share, less one), so only documents with one of
    those are paired, and common words join nothing.
    """
    words = items.select("item_id", S.tokens(F.col("text")).alias("b"))
    span = words.agg(F.min(F.size("b")), F.max(F.size("b"))).first()
    docs = docs.select("doc_id", S.tokens(F.col("text")).alias("w")).where(F.size("w").between(least * (span[0] or 0), (span[1] or 0) / least))
    need = F.ceil(F.lit(least) * F.size("b"))
    every = words.select("item_id", F.explode("b").alias("t"))
    held = docs.select(F.explode("w").alias("t")).join(every.select("t").distinct(), "t").groupBy("t").agg(F.count("*").alias("f"))
    ranked = every.join(held, "t").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ts"))
    keep = words.join(ranked, "item_id").select("item_id", "b", F.explode(F.slice(F.col("ts.t"), F.lit(1), F.greatest(F.size("b") - need + 1, F.lit(1)).cast("int"))).alias("t"))
    # sizes bound the share too: most pairs of a long and a short text end here
    sized = (F.col("n") >= F.lit(least) * F.col("m")) & (F.col("m") >= F.lit(least) * F.col("n"))
    keep = keep.select("item_id", F.size("b").alias("m"), F.col("t").alias("kt"))
    posts = docs.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("t"))
    pairs = posts.join(keep, (F.col("t") == F.col("kt")) & sized).select("doc_id", "item_id").distinct()
    x = pairs.join(docs, "doc_id").join(words, "item_id")
    shared = F.size(F.array_intersect("w", "b"))
    x = x.select("doc_id", "item_id", F.round(shared / (F.size("w") + F.size("b") - shared), 9).alias("score"))
    return x.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "score"), F.struct("score", -F.col("item_id"))).alias("m")).select("doc_id", "m.item_id", "m.score").where(F.col("score") >= least)
