"""Product matching, keyword rules and rule mining: the pipeline for products, and queries over parts and documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import similarity as S
from .made import pick, pick_sql
from .registry import query, table

# Words that make a product a snack or processed food.
SNACK = ["과자", "쿠키", "크래커", "초코", "빼빼로", "오예스", "붕어빵", "초코볼", "캔디", "사탕", "민트향", "헬씨넛", "로투스"]
PROCESSED = ["라면", "컵", "소스", "고추장", "요거트", "치즈", "와사비", "참기름", "양념", "주물럭", "햇반", "만두", "떡", "어묵", "캔"]
ACCEPT, SUGGEST, WEAK, SUGGESTIONS = 0.5, 0.3, 0.85, 3
RULE_SOURCES = ("receipt_rule_product_mapping", "receipt_rule_product_mapping_fallback")


@dataclass(frozen=True)
class Rules:
    """Ordered rules: non-item categories (name, words, patterns), alias replacements, and products with their ingredients."""

    non_items: list[tuple[str, list[str], list[str]]] = field(default_factory=list)
    aliases: list[tuple[str, str]] = field(default_factory=list)
    mappings: list[tuple[str, str]] = field(default_factory=list)


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)\s+", ""))


def table_lookup(pairs: dict[str, str], key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def first_wins(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Rules by compact key, the first of equal keys."""
    out: dict[str, str] = {}
    for a, b in pairs:
        for k in (a, "".join(a.split()), "".join(a.split()).lower()):
            out.setdefault(k, b)
    return out


def aliased(name: Column, rules: Rules) -> Column:
    """The name after all alias replacements in order, or what the whole name stands for."""
    whole = table_lookup(first_wins(rules.aliases), compact(name))
    return F.coalesce(whole, X.replaced(F.trim(name), [p for p in rules.aliases if p[0]]))


def non_item_category(name: Column, rules: Rules) -> Column:
    """The first category with a word in the name, whatever its case, or a pattern found in it."""
    t = F.trim(name)
    out = F.lit(None).cast("string")
    for label, words, patterns in reversed(rules.non_items):
        tests = [F.contains(F.lower(t), F.lit(w.lower())) for w in words if w] + [t.rlike(f"(?iU){p}") for p in patterns]
        if tests:
            hit = tests[0]
            for x in tests[1:]:
                hit = hit | x
            out = F.when((t != "") & hit, F.lit(label)).otherwise(out)
    return out


def any_word(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words)) if words else F.lit(False)


def item_type(name: Column, standard: Column, matched: Column, rules: Rules) -> Column:
    """NON_FOOD, SNACK, PROCESSED_FOOD, then INGREDIENT where an ingredient matched, else UNKNOWN."""
    both = F.concat_ws("\n", S.normalized(name), S.normalized(standard))
    out = F.coalesce(non_item_category(name, rules), non_item_category(standard, rules)).isNotNull()
    return F.when(out, "NON_FOOD").when(any_word(both, SNACK), "SNACK").when(any_word(both, PROCESSED), "PROCESSED_FOOD").when(matched, "INGREDIENT").otherwise("UNKNOWN")


def mapping_status(matched: Column, kind: Column) -> Column:
    return F.when(matched, "MAPPED").when(kind == "NON_FOOD", "EXCLUDED").otherwise("UNMAPPED")


def predict(products: DataFrame, ingredients: DataFrame, rules: Rules) -> DataFrame:
    """products (product_name) with the ingredient each stands for, how it was found, its type, status, reason and suggestions.

    ingredients: pos, ingredientId, ingredientName, category. Tried in order: the rules' ingredient for the product by
    equal name; then, over the rules' ingredient, the aliased and the original name, an equal name (in that order) or
    the best containment or similarity of at least ACCEPT, where the earlier name and the lower position win ties.
    """
    dim = ingredients.select("pos", "ingredientId", "ingredientName", "category", S.normalized(F.col("ingredientName")).alias("norm"))
    first = dim.groupBy("norm").agg(F.min("pos").alias("pos"))
    standard = F.coalesce(F.nullif(F.trim(aliased(F.col("product_name"), rules)), F.lit("")), F.trim(F.col("product_name")))
    mapped = table_lookup(first_wins(rules.mappings), compact(F.col("standard")))
    rows = products.select("product_name").distinct().withColumn("standard", standard).withColumn("mapped", mapped)
    tried = F.array_distinct(F.filter(F.array(F.trim("mapped"), F.col("standard"), F.trim("product_name")), lambda x: x.isNotNull() & (x != "")))
    names = rows.select("product_name", F.posexplode(F.transform(tried, S.normalized)).alias("turn", "name"))
    best = S.ranked(names.where("name <> ''"), dim.select("pos", F.col("norm").alias("name")), 1, ACCEPT).select("name", F.try_element_at("matches", F.lit(1)).alias("m")).where("m is not null")
    exact = names.join(first.withColumnRenamed("norm", "name"), "name").select("product_name", "turn", F.col("pos").alias("at"), F.lit(1.0).alias("score"), F.lit(0).alias("phase"))
    near = names.join(best, "name").select("product_name", "turn", F.col("m.pos").alias("at"), F.col("m.score").alias("score"), F.lit(1).alias("phase"))
    pick = exact.unionByName(near).groupBy("product_name").agg(F.min(F.struct("phase", F.when(F.col("phase") == 0, F.lit(0.0)).otherwise(-F.col("score")).alias("low"), "turn", "at", "score")).alias("b"))
    hit = rows.join(pick, "product_name", "left").join(dim.withColumnRenamed("pos", "at").select("at", "ingredientId", "ingredientName", "category", "norm"), F.col("b.at") == F.col("at"), "left")
    by_rule = F.col("mapped").isNotNull() & (F.col("b.turn") == 0)
    source = (
        F.when(by_rule & (F.col("b.phase") == 0), "receipt_rule_product_mapping")
        .when(by_rule, "receipt_rule_product_mapping_fallback")
        .when(F.col("b.phase") == 0, "normalized_exact_match")
        .when((F.col("standard") != F.trim("product_name")) & (F.element_at(tried, F.col("b.turn") + 1) == F.col("standard")), "product_alias_fuzzy_match")
        .otherwise("fuzzy_similarity")
    )
    matched = F.col("b").isNotNull()
    kind = item_type(F.col("product_name"), F.col("standard"), matched, rules)
    out = hit.select("product_name", "ingredientId", "ingredientName", "category", F.round("b.score", 4).alias("similarity"), F.when(matched, source).alias("mapping_source"), F.col("standard").alias("standard_product_name"), kind.alias("item_type"), matched.alias("matched"))
    out = out.withColumn("mapping_status", mapping_status(F.col("matched"), F.col("item_type"))).withColumn("reason", F.when(F.col("mapping_status") == "EXCLUDED", "비식품 또는 제외 대상").when(F.col("mapping_status") == "UNMAPPED", "DB에 일치하는 재료 없음")).drop("matched")
    return out.join(suggestions(out.where("mapping_status = 'UNMAPPED'"), dim), "product_name", "left").withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>")))


def suggestions(open_: DataFrame, dim: DataFrame) -> DataFrame:
    """product_name and the names of up to three ingredients of similarity SUGGEST or more, the nearest first."""
    keyed = open_.select("product_name", S.normalized(F.col("standard_product_name")).alias("name"))
    near = S.ranked(keyed, dim.select("pos", F.col("norm").alias("name")), SUGGESTIONS, SUGGEST)
    flat = keyed.join(near, "name").select("product_name", F.posexplode("matches").alias("k", "m")).join(dim.select(F.col("pos").alias("p"), "ingredientName"), F.col("m.pos") == F.col("p"))
    return flat.groupBy("product_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "ingredientName"))), lambda s: s["ingredientName"]).alias("suggestions"))


def mining_groups(items: DataFrame, matches: DataFrame, no_item: Column | None = None) -> DataFrame:
    """Candidates for new rules, by kind: alias, false_positive, unmapped and weak, with counts, files and mean confidence.

    items: pos, file_name, raw_name, normalized_name, confidence, parse_pattern. matches: product_name, ingredientName,
    mapping_source, similarity. An item is an alias candidate besides what else it is; of the others it is the first
    that applies; no_item (over the column product) is `false_positive` unless given. sample_files are the first five distinct ones; patterns are counted, the most frequent first.
    """
    name = F.coalesce(F.nullif(F.trim("normalized_name"), F.lit("")), F.trim("raw_name"))
    rows = items.withColumns({"raw": F.trim(F.coalesce("raw_name", F.lit(""))), "product": name}).where("product <> ''")
    alias = rows.where((compact(F.col("raw")) != "") & (compact(F.col("raw")) != compact(F.col("product")))).withColumns({"kind": F.lit("alias"), "key": F.col("raw"), "other": F.col("product")})
    met = rows.join(matches.withColumnRenamed("product_name", "product"), "product", "left")
    ruled = F.coalesce(F.col("mapping_source").isin(*RULE_SOURCES), F.lit(False))
    weak = ~ruled & (F.coalesce(F.col("similarity") < WEAK, F.lit(False)) | (compact(F.col("product")) != compact(F.col("ingredientName"))))
    kind = F.when(false_positive(F.col("product")) if no_item is None else no_item, "false_positive").when(F.col("ingredientName").isNull(), "unmapped").when(weak, "weak")
    rest = met.withColumns({"kind": kind, "key": F.col("product"), "other": F.when(kind == "weak", F.col("ingredientName"))}).where("kind is not null")
    cols = ["kind", "key", "other", "pos", "file_name", "confidence", "parse_pattern"]
    every = alias.select(cols).unionByName(rest.select(cols)).withColumn("other", F.coalesce("other", F.lit("")))
    keys = ["kind", "key", "other"]
    base = every.groupBy(*keys).agg(F.count("*").alias("count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    seen = every.groupBy(*keys, "file_name").agg(F.min("pos").alias("at")).where("file_name <> ''")
    from pyspark.sql import Window as W

    five = seen.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("at"))).where("k <= 5")
    files = five.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "file_name"))), lambda s: s["file_name"]).alias("sample_files"))
    shapes = every.where("parse_pattern <> ''").groupBy(*keys, "parse_pattern").agg(F.count("*").alias("n"))
    hist = shapes.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "parse_pattern"))), lambda s: F.concat(s["parse_pattern"], F.lit(":"), (-s["m"]).cast("string"))).alias("patterns"))
    return base.join(files, keys, "left").join(hist, keys, "left").withColumn("other", F.nullif("other", F.lit("")))


# Signs of lines that are no items, in order.
FALSE_POSITIVE = ["에누리", "(?i)s-?point", r"(?i)\bga[0-9]{4,}", r"(?i)\byldp", "지점", "보험", "약제비", "본인부담", "종량"]
SHOWN = 30


def false_positive(name: Column) -> Column:
    """Whether a product's name is likely no item: next to nothing, a sign of FALSE_POSITIVE, a number, or a price with hardly a letter."""
    t = F.trim(name)
    tight = F.regexp_replace(t, r"(?U)\s+", "")
    letters, digits_ = F.regexp_count(t, F.lit("[가-힣A-Za-z]")), F.regexp_count(t, F.lit(r"(?U)\d"))
    signs = F.lit(False)
    for p in FALSE_POSITIVE:
        signs = signs | t.rlike(p)
    number = (digits_ >= 5) & ~t.rlike("[가-힣A-Za-z]{2,}")
    price = t.rlike(r"[-+]?[0-9][0-9,]*\s*원?$") & (F.length(tight) <= 10) & (letters < 3)
    return (F.length(tight) <= 1) | signs | number | price


def report_rows(groups: DataFrame, limit: int = SHOWN) -> DataFrame:
    """kind, rank and line of the first `limit` candidates of each kind: the most frequent first, then by name."""
    from pyspark.sql import Window as W

    order = W.partitionBy("kind").orderBy(F.desc("count"), "key", F.coalesce("other", F.lit("")))
    files = F.coalesce(F.array_join("sample_files", ", "), F.lit(""))
    told = F.concat(F.lit(" (count="), F.col("count").cast("string"), F.lit(", avg_conf="), F.coalesce(F.col("avg_confidence").cast("string"), F.lit("None")), F.lit(", files="), files)
    line = F.when(F.col("kind") == "alias", F.concat(F.lit("- `"), "key", F.lit("` -> `"), "other", F.lit("`"), told, F.lit(")"))).when(
        F.col("kind") == "weak", F.concat(F.lit("- `"), "key", F.lit("`"), told, F.lit(", ingredient="), F.coalesce("other", F.lit("")), F.lit(")"))
    ).otherwise(F.concat(F.lit("- `"), "key", F.lit("`"), told, F.lit(")")))
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("kind", "rank", line.alias("line"))


SECTIONS = [("alias", "Alias Candidates"), ("unmapped", "Unmapped Products"), ("false_positive", "False Positive Item Candidates"), ("weak", "Weak Match Products")]


def markdown_report(groups: DataFrame, summary: dict[str, int | str], limit: int = SHOWN) -> str:
    """The report as text: the summary's counts, then a section for each kind. At most `limit` lines of each reach the driver."""
    rows = report_rows(groups, limit).orderBy("kind", "rank").collect()
    out = ["# Receipt Rule Candidate Report", "", *[f"- {k}: `{v}`" for k, v in summary.items()]]
    for kind, title in SECTIONS:
        own = [r["line"] for r in rows if r["kind"] == kind]
        out += ["", f"## {title}", "", *(own or ["- none"])]
    return "\n".join(out) + "\n"


# Queries over the driver's tables.

KEYWORDS = [("red", "warm"), ("blue", "cold"), ("large", "big"), ("small", "little"), ("plate", "flat"), ("bolt", "metal"), ("red plate", "warm flat"), ("gear", "metal")]
KEYWORD_SQL = "kw(pos, word, label) AS (VALUES " + ", ".join(f"({i}, '{w}', '{x}')" for i, (w, x) in enumerate(KEYWORDS)) + ")"


@query("keyword_category_longest", f"WITH {KEYWORD_SQL} SELECT p_partkey, coalesce(arg_max(label, {{'l': length(word), 'p': -pos}}), 'other') AS category FROM part LEFT JOIN kw ON contains(p_name, word) GROUP BY p_partkey")
def keyword_category_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.longest_keyword(F.col("p_name"), KEYWORDS, "other").alias("category"))


@query("keyword_semi_join", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def keyword_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return S.first_contained(docs, "text", items, "passage").select("doc_id", "item_id")


@query("search_contains_limit", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'plate') AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 20")
def search_contains_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains(S.normalized(F.col("p_name")), S.normalized(F.lit("Plate")))
    return table(spark, sf_dir, "part").where(hit & (F.col("p_type") == "ECONOMY")).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("product_match_exact_contains", """
WITH nm AS (SELECT DISTINCT replace(p_name, ' ', '') AS name FROM part),
d AS (SELECT row_number() OVER (ORDER BY s) AS pos, s AS name FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS s FROM part UNION SELECT 'redplate'))
SELECT nm.name, coalesce(min(d.pos) FILTER (d.name = nm.name), min(d.pos))::BIGINT AS pos, CASE WHEN count(*) FILTER (d.name = nm.name) > 0 THEN 0 ELSE 1 END AS phase FROM nm JOIN d ON contains(nm.name, d.name) OR contains(d.name, nm.name) GROUP BY nm.name""")
def product_match_exact_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import numbered

    part = table(spark, sf_dir, "part")
    nouns = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).union(spark.range(1).select(F.lit("redplate"))).distinct()
    got = S.tiers(part.select(S.normalized(F.col("p_name")).alias("name")).distinct(), numbered(nouns, "pos", F.col("name")), 0.5)
    return got.select("name", "pos", "phase")


@query("product_match_fuzzy_topk")
def product_match_fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other spellings of every product name; tests hold the ratio against the standard library."""
    from ..operators.ranking import numbered

    names = table(spark, sf_dir, "part").select(S.normalized(F.col("p_name")).alias("name")).distinct()
    dim = numbered(names, "pos", F.col("name"))
    got = S.ranked(names, dim, 4, ACCEPT).select("name", F.posexplode("matches").alias("k", "m"))
    return got.join(dim.select(F.col("pos").alias("p"), F.col("name").alias("other")), F.col("m.pos") == F.col("p")).where("name <> other").select("name", "other", F.round("m.score", 4).alias("similarity"))


@query("levenshtein_char_accuracy", "SELECT a.p_partkey, a.p_name AS reference, b.p_name AS heard, round(greatest(0, 1 - levenshtein(replace(a.p_name, ' ', ''), replace(b.p_name, ' ', '')) / length(replace(a.p_name, ' ', ''))::DOUBLE), 4) AS accuracy FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def levenshtein_char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name against the one that follows it, as what was read of it."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("reference"))
    heard = names.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("reference").alias("heard"))
    return names.join(heard, "p_partkey").select("p_partkey", "reference", "heard", F.round(S.char_accuracy(F.col("reference"), F.col("heard")), 4).alias("accuracy"))


MADE = ["국산 두부", "신라면 컵", "초코 쿠키", "종량제 봉투", "서울 우유", "깐 마늘", "S-POINT 적립", "참기름", "에누리", "red box", "1,200원", "GA12345 지점", "캔디", "보험료", "양파 망", "12345678"]
RULES = Rules(non_items=[("packaging", ["봉투", "BOX"], ["^종량"]), ("discount", ["s-point"], ["에누리"])], aliases=[("깐 마늘", "마늘"), ("두부", "콩두부"), ("콩두부", "순두부"), ("망", "")])
MADE_SQL = f"made AS (SELECT p_partkey, {pick_sql(MADE, 'p_partkey')} AS name, p_partkey % 3 = 0 AS matched FROM part)"


def made_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", pick(MADE, F.col("p_partkey")).alias("name"), (F.col("p_partkey") % 3 == 0).alias("matched"))


TYPED_SQL = f"""{MADE_SQL},
typed AS (SELECT *, regexp_replace(lower(trim(name)), '[^a-z0-9_가-힣]', '', 'g') AS norm FROM made),
kinds AS (SELECT p_partkey, matched, CASE WHEN regexp_matches(name, '(?i)봉투|box|^종량|s-point|에누리') THEN 'NON_FOOD' WHEN regexp_matches(norm, '{'|'.join(SNACK)}') THEN 'SNACK' WHEN regexp_matches(norm, '{'|'.join(PROCESSED)}') THEN 'PROCESSED_FOOD' WHEN matched THEN 'INGREDIENT' ELSE 'UNKNOWN' END AS item_type FROM typed)"""


@query("item_type_cascade", f"WITH {TYPED_SQL} SELECT p_partkey, item_type FROM kinds")
def item_type_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_names(spark, sf_dir).select("p_partkey", item_type(F.col("name"), F.lit(None).cast("string"), F.col("matched"), RULES).alias("item_type"))


@query("mapping_status_report", f"WITH {TYPED_SQL} SELECT item_type, CASE WHEN matched THEN 'MAPPED' WHEN item_type = 'NON_FOOD' THEN 'EXCLUDED' ELSE 'UNMAPPED' END AS mapping_status, count(*)::BIGINT AS n FROM kinds GROUP BY ALL")
def mapping_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = made_names(spark, sf_dir).withColumn("item_type", item_type(F.col("name"), F.lit(None).cast("string"), F.col("matched"), RULES))
    return typed.groupBy("item_type", mapping_status(F.col("matched"), F.col("item_type")).alias("mapping_status")).agg(F.count("*").alias("n"))


@query("alias_rewrite", f"WITH {MADE_SQL} SELECT p_partkey, CASE lower(replace(name, ' ', '')) WHEN '깐마늘' THEN '마늘' WHEN '두부' THEN '콩두부' WHEN '콩두부' THEN '순두부' WHEN '망' THEN '' ELSE replace(replace(replace(replace(name, '깐 마늘', '마늘'), '두부', '콩두부'), '콩두부', '순두부'), '망', '') END AS standard FROM made")
def alias_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_names(spark, sf_dir).select("p_partkey", aliased(F.col("name"), RULES).alias("standard"))


@query("false_positive_items", f"WITH {MADE_SQL}, t AS (SELECT *, regexp_replace(name, '\\s+', '', 'g') AS tight FROM made) SELECT p_partkey, name, length(tight) <= 1 OR regexp_matches(name, '에누리|(?i:s-?point)|(?i:\\bga[0-9]{{4,}})|(?i:\\byldp)|지점|보험|약제비|본인부담|종량') OR (length(regexp_replace(name, '[^0-9]', '', 'g')) >= 5 AND NOT regexp_matches(name, '[가-힣A-Za-z]{{2,}}')) OR (regexp_matches(name, '[-+]?[0-9][0-9,]*\\s*원?$') AND length(tight) <= 10 AND length(regexp_replace(name, '[^가-힣A-Za-z]', '', 'g')) < 3) AS no_item FROM t")
def false_positive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_names(spark, sf_dir).select("p_partkey", "name", false_positive(F.col("name")).alias("no_item"))


@query("mining_candidates", """
WITH i AS (SELECT p_partkey AS pos, p_brand AS file_name, p_name AS raw, CASE WHEN p_partkey % 4 = 0 THEN replace(p_name, 'red', 'ruby') ELSE p_name END AS product, p_retailprice / 1999.0::DOUBLE AS confidence FROM part),
m AS (SELECT *, CASE WHEN contains(product, 'gear') THEN NULL ELSE split_part(product, ' ', 2) END AS ingr, length(product) / 20.0 AS sim FROM i),
k AS (
  SELECT 'alias' AS kind, raw AS key, product AS other, pos, file_name, confidence FROM m WHERE raw <> product
  UNION ALL SELECT CASE WHEN contains(product, 'bolt') THEN 'false_positive' WHEN ingr IS NULL THEN 'unmapped' ELSE 'weak' END, product, CASE WHEN NOT contains(product, 'bolt') THEN ingr END, pos, file_name, confidence FROM m),
f0 AS (SELECT kind, key, other, file_name, min(pos) AS first_at FROM k GROUP BY kind, key, other, file_name), f AS (SELECT *, row_number() OVER (PARTITION BY kind, key, other ORDER BY first_at) AS k FROM f0),
s AS (SELECT kind, key, other, string_agg(file_name, ',' ORDER BY first_at) AS files FROM f WHERE k <= 5 GROUP BY ALL),
c AS (SELECT kind, key, other, count(*)::BIGINT AS count, round(avg(confidence), 4) AS avg_confidence FROM k GROUP BY ALL)
SELECT c.kind, c.key, c.other, c.count, c.avg_confidence, s.files FROM c JOIN s ON c.kind = s.kind AND c.key = s.key AND c.other IS NOT DISTINCT FROM s.other""")
def mining_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    normal = F.when(F.col("p_partkey") % 4 == 0, F.replace("p_name", F.lit("red"), F.lit("ruby"))).otherwise(F.col("p_name"))
    items = part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("file_name"), F.col("p_name").alias("raw_name"), normal.alias("normalized_name"), (F.col("p_retailprice") / 1999.0).alias("confidence"), F.lit("").alias("parse_pattern"))
    matches = items.select(F.col("normalized_name").alias("product_name")).distinct().where(~F.contains("product_name", F.lit("gear"))).select("product_name", F.split_part("product_name", F.lit(" "), F.lit(2)).alias("ingredientName"), F.lit("fuzzy_similarity").alias("mapping_source"), (F.length("product_name") / 20).alias("similarity"))
    got = mining_groups(items, matches, F.contains(F.col("product"), F.lit("bolt")))
    return got.select("kind", "key", "other", "count", "avg_confidence", F.array_join("sample_files", ",").alias("files"))


@query("mining_report", """
WITH g AS (SELECT p_brand AS k, count(*)::BIGINT AS n, round(avg(p_retailprice / 1999.0), 4) AS c FROM part WHERE NOT contains(p_name, 'gear') GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, k) AS rank FROM g)
SELECT 'unmapped' AS kind, rank::INT AS rank, k AS name FROM r WHERE rank <= 30""")
def mining_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(~F.contains("p_name", F.lit("gear")))
    items = part.select(F.col("p_partkey").alias("pos"), F.lit("").alias("file_name"), F.col("p_brand").alias("raw_name"), F.col("p_brand").alias("normalized_name"), (F.col("p_retailprice") / 1999.0).alias("confidence"), F.lit("").alias("parse_pattern"))
    none = spark.createDataFrame([], "product_name string, ingredientName string, mapping_source string, similarity double")
    rows = report_rows(mining_groups(items, none, F.lit(False)))
    return rows.select("kind", F.col("rank").cast("int").alias("rank"), F.regexp_extract("line", "^- `([^`]*)`", 1).alias("name"))


PRODUCTS = ["두부", "국산 콩 두부", "서울우유", "깐 마늘", "종량제 봉투", "초코 쿠키", "zzz"]
PREDICTED = [("두부", "normalized_exact_match", "MAPPED"), ("두부", "fuzzy_similarity", "MAPPED"), ("우유", "receipt_rule_product_mapping", "MAPPED"), ("마늘", "normalized_exact_match", "MAPPED"), (None, None, "EXCLUDED"), (None, None, "UNMAPPED"), (None, None, "UNMAPPED")]


@query("predicted_products", f"SELECT p_partkey, {pick_sql(PRODUCTS, 'p_partkey')} AS product_name, {pick_sql([x[0] or '-' for x in PREDICTED], 'p_partkey')} AS ingredient, {pick_sql([x[1] or '-' for x in PREDICTED], 'p_partkey')} AS source, {pick_sql([x[2] for x in PREDICTED], 'p_partkey')} AS mapping_status FROM part")
def predicted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matching of products, whose answers for these names are known."""
    rules = Rules(non_items=[("packaging", ["봉투"], [])], aliases=[("깐 마늘", "마늘")], mappings=[("서울우유", "우유")])
    ingredients = spark.createDataFrame([(0, "i0", "두부", "가공식품"), (1, "i1", "우유", "유제품"), (2, "i2", "마늘", "채소/과일"), (3, "i3", "돼지고기", "정육/계란")], "pos long, ingredientId string, ingredientName string, category string")
    named = table(spark, sf_dir, "part").select("p_partkey", pick(PRODUCTS, F.col("p_partkey")).alias("product_name"))
    got = predict(named.select("product_name").distinct(), ingredients, rules)
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return named.join(got, "product_name").select("p_partkey", "product_name", dash("ingredientName").alias("ingredient"), dash("mapping_source").alias("source"), "mapping_status")
