"""Queries that run the recipe pipeline's own rules over the driver's tables, on words that a row's number picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import receipts_v1 as V1
from . import recipe_etl as R
from . import recipe_rules as K
from .made import first_match_sql, pick, pick_sql, quoted
from .registry import query, table

STEMS = ["김치", "두부", "소고기", "배추", "고등어", "감자", "참치", "오이", "녹차", "찐 빵과", "탕수육과", "콩나물", "해물", "계란", "떡", "장어", "콩", "보리"]
ENDS = ["찌개", "볶음", "구이", "조림", "전", "무침", "튀김", "찜", "샐러드", "김치", "밥", "국수", "케이크", "장아찌", "피클", "불고기", "수육", "된장", "주먹밥", "요리", "냉채", "전골", "소스"]
STEPS = ["물을 붓고 팔팔 끓인다", "팬에 볶아 낸다", "오븐에 노릇하게 구워 낸다", "찜기에 쪄서 식힌다", "180도 기름에 넣고 튀긴다", "양념을 넣고 섞어 무친다", "간장에 조려 윤기가 나게 한다", "소금을 뿌려 절여 숙성한다", "끓는 물에 데쳐 삶는다", "접시에 담는다", "얇게 부쳐 지진다", ""]
CATEGORIES = ["김치류", "찌개/전골류", "볶음류", "튀김류", "전/부침류", "구이류", "나물/무침류", "국/탕류", "밥류", "빵/과자류", "기타"]

TITLE_SQL = f"{pick_sql(STEMS, 'p_partkey')} || {pick_sql(['', ' '], 'p_partkey // 5')} || {pick_sql(ENDS, 'p_partkey // 3')}"
DISH_SQL = f"dish AS (SELECT p_partkey, {TITLE_SQL} AS title, {pick_sql(STEPS, 'p_partkey // 7')} || ' ' || {pick_sql(STEPS, 'p_partkey // 11')} AS steps, {pick_sql(CATEGORIES, 'p_partkey // 2')} AS category FROM part)"


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    by = lambda n: F.floor(k / n)
    title = F.concat(pick(STEMS, k), pick(["", " "], by(5)), pick(ENDS, by(3)))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.concat_ws(" ", pick(STEPS, by(7)), pick(STEPS, by(11))).alias("steps"), pick(CATEGORIES, by(2)).alias("category"))


def kimchi_sql(title: str) -> str:
    return f"CASE WHEN regexp_matches({title}, {quoted(K.KIMCHI_PASTE)}) THEN '양념/소스류' WHEN regexp_matches({title}, {quoted(K.KIMCHI_ITSELF)}) THEN '김치류' ELSE {first_match_sql(title, K.KIMCHI_DISHES, quoted('김치류'))} END"


@query("kimchi_categories", f"WITH {DISH_SQL} SELECT p_partkey, title, {kimchi_sql('title')} AS category FROM dish")
def kimchi_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dishes(spark, sf_dir).select("p_partkey", "title", K.kimchi_category(F.col("title")).alias("category"))


def method_sql() -> str:
    """The way of cooking: title, else most points, else by category; as one SELECT over dish."""
    points = []
    for _, words, pattern, said, weight in K.METHODS:
        hits = " + ".join(f"regexp_matches(steps, {quoted(p)})::INT" for p in said)
        title = f"CASE WHEN regexp_matches(title, {quoted('|'.join(words))}) THEN 10 ELSE 0 END + " if words else ""
        points.append(f"({title}CASE WHEN regexp_matches(title, {quoted(pattern)}) THEN 8 ELSE 0 END + ({hits}) * {weight})::DOUBLE")
    names = f"[{', '.join(quoted(m[0]) for m in K.METHODS)}]"
    by_category = " ".join(f"WHEN {quoted(c)} THEN {quoted(m)}" for c, m in K.METHOD_OF_CATEGORY.items())
    return f"""points AS (SELECT *, [{', '.join(points)}] AS p FROM dish),
best AS (SELECT *, list_max(p) AS most, list_position(p, list_max(p)) AS place FROM points),
cooked AS (SELECT p_partkey, title, category, coalesce({first_match_sql('title', K.METHOD_TITLES, 'NULL')}, CASE WHEN most >= 1 THEN {names}[place] END, CASE category {by_category} ELSE '기타' END) AS method FROM best)"""


@query("cooking_methods", f"WITH {DISH_SQL}, {method_sql()} SELECT p_partkey, method FROM cooked")
def cooking_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dishes(spark, sf_dir).select("p_partkey", K.cooking_method(F.col("title"), F.col("steps"), F.col("category")).alias("method"))


@query("method_conflicts", f"""WITH {DISH_SQL}, {method_sql()}, s AS (SELECT p_partkey, title, category, CASE WHEN category = '김치류' AND regexp_matches(title, {quoted(K.KIMCHI_ITSELF)}) THEN '절이기' ELSE method END AS method FROM cooked)
SELECT p_partkey, method, CASE WHEN category = '찌개/전골류' AND method = '조리기' AND contains(title, '조림') THEN '조림류' WHEN category = '볶음류' AND method = '굽기' AND contains(title, '불고기') THEN '구이류' WHEN category = '볶음류' AND method = '무치기' AND contains(title, '무침') THEN '나물/무침류'
  WHEN category = '튀김류' AND method = '굽기' THEN '구이류' WHEN category = '구이류' AND method = '찌기' THEN '찜류' WHEN category = '나물/무침류' AND method NOT IN ('무치기', '볶기') THEN '반찬' ELSE category END AS category FROM s""")
def method_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cooked = dishes(spark, sf_dir).withColumn("method", K.cooking_method(F.col("title"), F.col("steps"), F.col("category")))
    settled = cooked.withColumn("method", K.settled_method(F.col("category"), F.col("method"), F.col("title")))
    return settled.select("p_partkey", "method", K.settled_category(F.col("category"), F.col("method"), F.col("title")).alias("category"))


MISREAD = [f"{a}{t}" for a, _ in V1.CORRECTIONS for t in ("", " 1봉")] + ["볶음까루", "닭쌀", "매운 쟝", "기릉", "깨끗한 물", "국산콩나묾"]


def corrected_sql(text: str) -> str:
    done = text
    for a, b in V1.CORRECTIONS:
        done = f"replace({done}, {quoted(a)}, {quoted(b)})"
    return done


@query("corrected_names", f"""WITH r AS (SELECT p_partkey, trim({pick_sql(MISREAD, 'p_partkey')}) AS t FROM part), d AS (SELECT p_partkey, t, {corrected_sql('t')} AS done FROM r),
e AS (SELECT *, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(t, '([가-힣])까루', '\\1가루', 'g'), '([가-힣])쌀$', '\\1살'), '배츄', '배추'), '([가-힣])쟝', '\\1장', 'g'), '([가-힣])릉$', '\\1름') AS f FROM d)
SELECT p_partkey, CASE WHEN done <> t THEN done ELSE regexp_replace(f, '([가-힣])묾$', '\\1물') END AS name FROM e""")
def corrected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V1.corrected(pick(MISREAD, F.col("p_partkey"))).alias("name"))


# The dictionary and its rules, over orders as recipes and picked names as ingredients.

RAW = ["달걀", "다진 마늘", "계란(2개)", "양념:간장", "소금약간", "다진", "●두부", "새우", "양송이버섯", "호두", "사과", "쌀", "생수", "삼겹살", "우유", "알 수 없는 것", "케찹", "참깨약간", "재료:대파"]
STANDARD = ["계란", "마늘", "계란", "간장", "소금", None, "두부", "새우", "양송이버섯", "호두", "사과", "쌀", "생수", "삼겹살", "우유", "알수없는것", "케첩", "깨", "대파"]


def class_sql(name: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({name}, {quoted(p)}) THEN {quoted(k)}" for p, k, *_ in R.CLASSES)
    return f"CASE {cases} ELSE 'other' END"


def days_sql(category: str) -> str:
    return "CASE " + category + " " + " ".join(f"WHEN {quoted(k)} THEN {d}" for _, k, _, d, _ in R.CLASSES) + " ELSE 7 END"


DICT_SQL = f"""line AS (SELECT l_orderkey AS r, {pick_sql(RAW, 'l_partkey')} AS raw, ([{', '.join('NULL' if x is None else quoted(x) for x in STANDARD)}])[l_partkey % {len(RAW)} + 1] AS standard FROM lineitem),
n AS (SELECT standard, count(DISTINCT r) AS n FROM line WHERE standard IS NOT NULL GROUP BY standard),
master AS (SELECT row_number() OVER (ORDER BY n DESC, standard)::INT AS id, standard AS standard_name, {class_sql('standard')} AS category, n::BIGINT AS observed_count FROM n)"""


def made_dictionary(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.collect_list(pick(RAW, F.col("l_partkey"))).alias("ingredient_names"))
    return R.dictionary(names)


@query("dictionary_master", f"WITH {DICT_SQL} SELECT * FROM master")
def dictionary_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made_dictionary(spark, sf_dir)["master"].select("id", "standard_name", "category", "observed_count")


@query("dictionary_alias", f"WITH {DICT_SQL} SELECT m.id AS ingredient_id, line.raw AS alias_name, count(*)::BIGINT AS observed_count FROM line JOIN master m ON m.standard_name = line.standard WHERE line.raw <> line.standard GROUP BY ALL")
def dictionary_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordered_aliases(made_dictionary(spark, sf_dir)["alias"].select("ingredient_id", "alias_name", "observed_count"))


@query("shelf_rules", f"WITH {DICT_SQL} SELECT category, {days_sql('category')} AS days, count(*)::BIGINT AS n FROM (SELECT DISTINCT category FROM master) GROUP BY category")
def shelf_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = made_dictionary(spark, sf_dir)["shelf_rule"]
    return rules.groupBy("category", F.col("shelf_life_days").alias("days")).agg(F.count("*").alias("n"))


@query("dictionary_lookup", f"WITH {DICT_SQL}, own AS (SELECT standard_name AS name, 0 AS pri, id FROM master UNION ALL SELECT DISTINCT line.raw, 1, m.id FROM line JOIN master m ON m.standard_name = line.standard WHERE line.raw <> line.standard), w AS (SELECT name, arg_max(id, pri * 1000000 + id) AS id FROM own GROUP BY name) SELECT w.name, m.standard_name, m.category FROM w JOIN master m USING (id)")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = made_dictionary(spark, sf_dir)
    return R.lookup(d["master"], d["alias"]).select("name", "standard_name", "category")


@query("canonical_names", f"WITH {DICT_SQL}, f AS (SELECT r, standard, min(p) AS p FROM (SELECT l_orderkey AS r, l_linenumber AS p, ([{', '.join('NULL' if x is None else quoted(x) for x in STANDARD)}])[l_partkey % {len(RAW)} + 1] AS standard FROM lineitem) WHERE standard IS NOT NULL GROUP BY r, standard) SELECT r AS recipe_id, string_agg(standard, ',' ORDER BY p, standard) AS names FROM f GROUP BY r")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = pick(RAW, F.col("l_partkey"))
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("recipe_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", R.canonical(word).alias("c"), word.alias("w")))), lambda s: s["w"]).alias("names"))
    return lists.select("recipe_id", F.array_join(R.canonical_names(F.col("names")), ",").alias("names")).where("names <> ''")


@query("classify_case_cascade", f"WITH r AS (SELECT p_partkey, {pick_sql([x for x in STANDARD if x], 'p_partkey')} AS name FROM part) SELECT p_partkey, {class_sql('name')} AS class, {days_sql(class_sql('name')).replace('CASE CASE', 'CASE (CASE').replace(' END WHEN', ' END) WHEN', 1)} AS days FROM r")
def classify_case_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.classified(pick([x for x in STANDARD if x], F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", c["category"].alias("class"), c["days"].alias("days"))


# Landed pages and grids.


@query("landed_nutrition", """WITH f AS (SELECT p_partkey, p_name || '_' || p_brand AS title, p_size::DOUBLE AS kcal, p_retailprice AS water, p_partkey % 4 AS k FROM part)
SELECT p_partkey AS pos, split_part(title, '_', 1) AS base_name, 2 AS n, '에너지=' || kcal::VARCHAR || 'kcal' AS summary FROM f WHERE k = 0""")
def landed_nutrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda c: c.cast("string")
    pages = part.select(k.alias("pos"), text(k).alias("FOOD_CD"), F.concat("p_name", F.lit("_"), "p_brand").alias("FOOD_NM_KR"), F.lit("c").alias("FOOD_CAT1_NM"), F.when(k % 2 == 0, R.TARGET_FOODS["FOOD_OR_NM"]).otherwise("x").alias("FOOD_OR_NM"), F.when(k % 4 == 0, R.TARGET_FOODS["DB_CLASS_NM"]).otherwise("y").alias("DB_CLASS_NM"), F.format_string(" %s ", text(F.col("p_size"))).alias("AMT_NUM1"), F.format_number("p_retailprice", 2).alias("AMT_NUM2"), F.lit("none").alias("AMT_NUM3"), F.lit("").alias("AMT_NUM4"))
    got = R.landed_nutrition(pages)
    return got.select("pos", "base_name", F.size("nutrients").alias("n"), F.array_join(F.transform(F.map_entries("nutrition_summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("summary"))


@query("landed_foods", "WITH f AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN p_name || '(' || p_brand || ')' WHEN p_partkey % 3 = 1 THEN p_name || ' 300g' ELSE p_name || '..' END AS raw, p_name AS name FROM part) SELECT name, min(pos)::BIGINT AS pos, arg_min(raw, pos) AS name_raw FROM f WHERE length(name) >= 2 GROUP BY name")
def landed_foods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat("p_name", F.lit("("), "p_brand", F.lit(")"))).when(k % 3 == 1, F.concat("p_name", F.lit(" 300g"))).otherwise(F.concat("p_name", F.lit("..")))
    pages = table(spark, sf_dir, "part").select(k.alias("pos"), raw.alias("FOOD_NM_KR"), F.lit("a").alias("FOOD_CAT1_NM"), F.lit("b").alias("FOOD_CAT2_NM"), F.lit(None).cast("string").alias("MAKER_NM"))
    return R.landed_foods(pages).select("name", F.col("pos").cast("long").alias("pos"), "name_raw")


@query("landed_recipes", """WITH p AS (SELECT l_orderkey AS k, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1), s AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS first FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS pos, coalesce(parts, '') AS parts, coalesce(n, 0)::INT AS n_steps, first::INT AS first_step FROM orders LEFT JOIN p ON p.k = o_orderkey LEFT JOIN s ON s.k = o_orderkey""")
def landed_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, key = table(spark, sf_dir, "lineitem"), F.col("l_orderkey").cast("string").alias("RECIPE_ID")
    info = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("RECIPE_ID"), F.col("o_orderpriority").alias("title"))
    parts = line.where("l_linenumber % 2 = 1").select(key, F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("p"), F.col("l_partkey").cast("string").alias("name"), F.lit("").alias("amount"))
    order = F.struct("pos", "p")  # lines of one number go by their part
    steps = line.where("l_linenumber % 2 = 0").select(key, F.col("l_linenumber").cast("int").alias("step"), F.lit("d").alias("description"), F.lit("").alias("tip"))
    got = R.landed_recipes(info, parts.withColumn("pos", order).drop("p"), steps)
    return got.select("pos", F.array_join(F.transform("ingredients", lambda i: i["name"]), ",").alias("parts"), F.size("steps").alias("n_steps"), F.get("steps", F.lit(0))["step"].alias("first_step"))


@query("reformatted_recipes", r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), s AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS k, ls FROM d)
SELECT doc_id AS id, count(*) FILTER (trim(ls[k]) <> '')::INT AS n_steps, coalesce(max(k) FILTER (trim(ls[k]) <> ''), 0)::INT AS last_step, lang || ' 1g, ' || source AS ingredients_raw FROM s JOIN documents USING (doc_id) GROUP BY doc_id, lang, source""")
def reformatted_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda n, a: F.struct(n.alias("name"), F.lit(a).alias("amount"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("t").alias("title"), F.lit("c").alias("category"), F.lit("").alias("description"), F.array(pair(F.col("lang"), " 1g "), pair(F.lit(" "), "2"), pair(F.col("source"), "")).alias("ingredients"), F.split("text", "\n").alias("steps"))
    got = R.reformatted(docs, "s")
    return got.select("id", F.size("steps").alias("n_steps"), F.coalesce(F.array_max(F.transform("steps", lambda s: s["step"])), F.lit(0)).alias("last_step"), "ingredients_raw")


@query("ingredient_dimension", f"""WITH r AS (SELECT p_partkey AS pos, {pick_sql(['[국산] ', '', '- 양념: '], 'p_partkey')} || {pick_sql(['두부', '깻잎', '약간', '우유'], 'p_partkey // 3')} AS raw, {pick_sql(['두부', '깻잎', '약간', '우유'], 'p_partkey // 3')} AS name FROM part),
f AS (SELECT name, min(pos)::BIGINT AS pos, arg_min(raw, pos) AS raw FROM r WHERE name <> '약간' GROUP BY name)
SELECT name, pos, CASE WHEN raw = '[국산] 두부' THEN 'domestic' WHEN name = '두부' THEN 'bean' WHEN name = '우유' THEN 'dairy' ELSE '기타' END AS category FROM f""")
def ingredient_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.concat(pick(["[국산] ", "", "- 양념: "], k), pick(["두부", "깻잎", "약간", "우유"], F.floor(k / 3)))
    known = spark.createDataFrame([("[국산] 두부", "domestic"), ("두부", "bean"), ("우유", "dairy")], "name string, category string")
    return R.ingredient_dimension(table(spark, sf_dir, "part").select(k.alias("pos"), raw.alias("raw")), known).select("name", "pos", "category")


@query("parse_success", "SELECT count(*)::BIGINT AS n, count(*) FILTER (l_quantity % 3 <> 0 OR l_linenumber % 2 = 0)::BIGINT AS parsed, round(count(*) FILTER (l_quantity % 3 <> 0 OR l_linenumber % 2 = 0) / count(*)::DOUBLE, 4) AS share FROM lineitem")
def parse_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.parse_success(table(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 3).alias("amount"), F.when(F.col("l_linenumber") % 2 == 0, "g").otherwise("").alias("unit")))


@query("consolidated_recipes", """WITH t AS (SELECT s_suppkey AS k, '요리 ' || (s_suppkey % 7)::VARCHAR AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'public' ELSE 'epis' END AS source FROM supplier),
g AS (SELECT replace(title, ' ', '') AS key, count(DISTINCT source) AS n FROM t GROUP BY 1) SELECT 'R' || lpad(row_number() OVER (ORDER BY key)::VARCHAR, 5, '0') AS id, n::INT AS n_sources FROM g""")
def consolidated_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as recipes of two sources, through the whole consolidation."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("요리 "), (F.col("s_suppkey") % 7).cast("string")).alias("title"))
    got = R.consolidate([R.unified(own.where("pos % 2 = 0"), "public"), R.unified(own.where("pos % 2 = 1"), "epis")])
    return got.select("id", F.size("sources").alias("n_sources"))
