"""The first receipt engine: lines by type, prices by look-ahead, corrected and normalised names, food alone, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import merging, sequences, similarity

# Patterns of line types, prices, non-food and names, and the rewrites of misread endings.
SKIPPED = r"사업자|전화|번호|주소|카드|승인|가맹점|계산대|합\s*계|소\s*계|부가세|과세|면세|총액|지불|할인|상품명|단가|수량|금액|판매일|신용|면세물품|과세물품|포인트|적립|잔액|회원|거래|결제|영수증|감사합니다|고객|안내|문의|[=\-]{3,}"
DATED = r"\d{4}[.\-/년]\s*\d{1,2}[.\-/월]\s*\d{1,2}"
NON_FOOD = r"비닐|봉투|장바구니|포장|손잡이|에코백|화장지|티슈|휴지|물티슈|키친타올|세제|세탁|섬유유연|표백|주방세제|식기세척|샴푸|린스|컨디셔너|바디워시|치약|칫솔|면도|건전지|전구|테이프|접착|쓰레기|마스크|반창고|밴드|면봉"
TIMES, TAIL_PRICE = r"(\d+)\s*[*xX×]\s*([\d,]+)\s*원?\s*$", r"([\d,]{3,})\s*원?\s*$"
SPEC = r"\s*[\(\[]?\s*\d+[\s\*xX×]*\d*\s*[gGmMlLkKcC개입봉지팩맥단인분세트호]*\s*[\)\]]?\s*$"
NAME_RULES = [(r"^\d{1,3}[)\.\s]+", ""), (r"[#\*\$\|/\\:]+", " "), (SPEC, ""), (r"\(.*?\)", ""), (r"\s{2,}", " ")]
OLD_NAME_RULES = [(r"^\d{1,3}[)\.\s]+", ""), (r"^\d{2,3}\s*", ""), (r"^[\(\)주초푸삼립농심팔도크라운CJ오뚜기]+\)", ""), (r"[#\*\$\|/\\:]+", " "), (SPEC, ""), (r"\(.*?\)", ""), (r"\s{2,}", " ")]
SHORT_FORMS = {"삼겹": "삼겹살", "목심": "목살", "닭가슴": "닭가슴살", "양송이": "양송이버섯", "팽이": "팽이버섯", "새송이": "새송이버섯", "느타리": "느타리버섯", "표고": "표고버섯"}
MISREAD = [(r"(\w)까루", "$1가루"), (r"(\w)쌀$", "$1살"), ("배츄", "배추"), (r"(\w)쟝", "$1장"), (r"(\w)릉$", "$1름"), (r"(\w)묾$", "$1물")]
# Misread words of receipts and what they stand for, in the order in which they are replaced.
CORRECTIONS = [tuple(x.split(">")) for x in (
    "깨잎>깻잎 깨입>깻잎 깨닢>깻잎 갯잎>깻잎 깨앞>깻잎 감급>감귤 감굴>감귤 감골>감귤 방가루>빵가루 빵까루>빵가루 밀까루>밀가루 밀카루>밀가루 콩나묾>콩나물 콩나믈>콩나물 숙주나묾>숙주나물 게란>계란 겨란>계란 게랑>계란 겨랑>계란 겟란>계란 달갈>달걀 달갤>달걀 달결>달걀 "
    "데파>대파 데퍄>대파 양퍄>양파 양따>양파 감져>감자 갑자>감자 갑져>감자 고구며>고구마 고규마>고구마 뱃추>배추 배츄>배추 시굼치>시금치 시금취>시금치 양배츄>양배추 당긴>당근 당귄>당근 삼겹싸>삼겹살 삼겹쌀>삼겹살 삼격살>삼겹살 삼경살>삼겹살 목쌀>목살 항정쌀>항정살 갈매기쌀>갈매기살 "
    "닭가슴쌀>닭가슴살 부채쌀>부채살 차돌백이>차돌박이 차돌바기>차돌박이 갈취>갈치 참취>참치 오이스터소스>굴소스 브로꼴리>브로콜리 아보카또>아보카도 아보까도>아보카도 돗마토>토마토 토마또>토마토 또마토>토마토 바내나>바나나 블루배리>블루베리 블루배러>블루베리 딸끼>딸기 멸치엑젓>멸치액젓 멸치엑것>멸치액젓 "
    "깍뚜기>깍두기 깍뚜끼>깍두기 냉삼>냉동삼겹살 리쳄>리챔 리첌>리챔 참지캔>참치캔 참취캔>참치캔 라몐>라면 우유우>우유 요구르뜨>요구르트 요구르또>요구르트 요거뜨>요거트 고춧까루>고춧가루 고춧카루>고춧가루 고추까루>고춧가루 간쟝>간장 갼장>간장 된쟝>된장 고추쟝>고추장 참기릉>참기름 들기릉>들기름 식용류>식용유 올리브류>올리브유"
).split()]
STORES, OLD_STORES = "마트|스토어|슈퍼|식자재|하나로|이마트|홈플러스|롯데|농협", "마트|식자재|스토어|슈퍼"
OLD_JUNK = r"(?i)^[\d\s/\-\.\:,]+$|^[가-힣]{0,2}:.*$|사업자|대표|주소|전화|번호|계산대|토요일|일요일|월요일|화요일|수요일|목요일|금요일|합계|소계|부가세|과세|면세|카드|승인|할인|거스름|영수증|감사합니다|^[/\-=]+$"
HEAD_DATES = [r"(\d{4})[.\-/년]\s*(\d{1,2})[.\-/월]\s*(\d{1,2})[일]?", r"(\d{4})(\d{2})(\d{2})"]


def line_type(text: Column) -> Column:
    """separator, barcode, price, date, header, product or unknown, the first that fits."""
    t = F.trim(text)
    has_date = t.rlike(DATED)
    return (
        F.when(t == "", "unknown").when(t.rlike(r"^[=\-·_]{3,}$"), "separator").when(t.rlike(r"^\d{8,}$"), "barcode").when(t.rlike(r"^[\d,]+\s*[#\*]?$"), "price")
        .when(t.rlike(SKIPPED), F.when(has_date, "date").otherwise("header")).when(has_date | t.rlike(r"^\d{8}$"), "date").when(t.rlike("[가-힣]") & (F.length(t) >= 2), "product").otherwise("unknown")
    )


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("long")


def inline_price(text: Column) -> Column:
    """Quantity times price at the end, or the number of three characters or more there."""
    product = digits(F.regexp_extract(text, TIMES, 1)) * digits(F.regexp_extract(text, TIMES, 2))
    return F.coalesce(product, digits(F.regexp_extract(text, TAIL_PRICE, 1)))


def corrected(text: Column, corrections: list[tuple[str, str]] | None = None) -> Column:
    """Misspellings replaced in order; only where that changes nothing, the rewrites of misread endings."""
    t = F.trim(text)
    done = X.replaced(t, CORRECTIONS if corrections is None else corrections)
    return F.when(done != t, done).otherwise(X.rewritten(t, MISREAD))


def product_name(text: Column, rules: list[tuple[str, str]] = NAME_RULES) -> Column:
    name = F.trim(X.rewritten(F.trim(text), rules))
    out = X.recoded(name, SHORT_FORMS, "") if rules is NAME_RULES else name
    return F.coalesce(F.nullif(out, F.lit("")), F.trim(text))


def is_food(name: Column) -> Column:
    return ~(name.rlike(NON_FOOD) | (F.length(name) < 2) | name.rlike(r"^[\d\s,.]+$"))


def known_label(name: Column, labels: DataFrame | None, df: DataFrame) -> DataFrame:
    """df with known: whether a label is in the name or the name in a label.

    Both ways round, what is contained is one of the other's substrings; names are short, so distinct names and labels
    meet on their substrings by equal keys, and no label reaches the driver.
    """
    if labels is None:
        return df.withColumn("known", F.lit(False))
    tight = F.regexp_replace(name, r"(?U)\s+", "")
    keyed = df.withColumn("_tight", tight)
    names = keyed.select(F.col("_tight").alias("n")).distinct()
    own = labels.select(F.col("name").alias("l")).where("l <> ''").distinct()
    inside = similarity.substrings(names, "n", "l").join(own, "l").select("n")
    around = similarity.substrings(own, "l", "n").join(names, "n").select("n")
    hit = inside.unionByName(around).distinct().select(F.col("n").alias("_tight"), F.lit(True).alias("known"))
    blank = F.col("_tight") == ""  # an empty name is in any label
    some = F.lit(not own.isEmpty())
    return keyed.join(hit, "_tight", "left").withColumn("known", F.coalesce("known", blank & some)).drop("_tight")


def items(lines: DataFrame, keywords: list[tuple[str, str]], corrections: list[tuple[str, str]] | None = None, labels: DataFrame | None = None) -> DataFrame:
    """receipt_id, line_idx, product_name_raw, product_name, amount_krw and category of every food on receipts.

    lines: receipt_id, line_idx, text. A product's price stands on its line or on one of the next three lines before
    another product. Names are corrected and normalised, non-food is left out, then the first of equal names stays,
    then what has no category and no known label goes. keywords (word, category) are a parameter, the longest wins.
    """
    typed = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.trim("text")).withColumn("kind", line_type(F.col("text"))).withColumn("price", digits(F.col("text")))
    paired = sequences.look_ahead(typed, "receipt_id", "line_idx", "kind", "price", "price", "product").where("kind = 'product'")
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", TIMES, ""), TAIL_PRICE, ""))
    raw = paired.select("receipt_id", "line_idx", bare.alias("product_name_raw"), F.coalesce(inline_price(F.col("text")), F.col("found")).alias("amount_krw")).where(F.length("product_name_raw") >= 2)
    named = raw.withColumn("product_name", product_name(corrected(F.col("product_name_raw"), corrections))).where(is_food(F.col("product_name")))
    first = merging.first_wins(named.withColumn("key", similarity.normalized(F.col("product_name"))), ["receipt_id", "key"], "line_idx").drop("key")
    sorted_ = first.withColumn("category", X.longest_keyword(F.col("product_name"), keywords, "기타"))
    return known_label(F.col("product_name"), labels, sorted_).where((F.col("category") != "기타") | F.col("known")).drop("known")


def old_items(lines: DataFrame, keywords: list[tuple[str, str]], labels: DataFrame | None = None, drop_other: bool = True) -> DataFrame:
    """The engine before it: junk lines go, names are normalised by older rules, and equal names but for case and space count once."""
    kept = lines.where(F.trim(F.coalesce("text", F.lit(""))) != "").where(~F.trim("text").rlike(OLD_JUNK)).withColumn("product_name", product_name(F.col("text"), OLD_NAME_RULES)).where((F.length("product_name") >= 2) & ~F.col("product_name").rlike(OLD_JUNK))
    first = merging.first_wins(kept.withColumn("key", merging.compact_key(F.col("product_name"))), ["receipt_id", "key"], "line_idx").drop("key")
    sorted_ = known_label(F.col("product_name"), labels, first.withColumn("category", X.longest_keyword(F.col("product_name"), keywords, "기타")))
    named = sorted_.withColumn("category", F.when((F.col("category") == "기타") & F.col("known"), "미분류 식품").otherwise(F.col("category"))).drop("known")
    got = named.select("receipt_id", "line_idx", F.col("text").alias("product_name_raw"), "product_name", F.split_part("category", F.lit("/"), F.lit(1)).alias("category_major"), F.split_part("category", F.lit("/"), F.lit(2)).alias("category_sub"))
    return got.where("category_major <> '기타'") if drop_other else got


def head(lines: DataFrame, stores: str = STORES, store_lines: int = 15, date_lines: int = 25) -> DataFrame:
    """receipt_id with store_name (the first of the head lines that names one) and purchase_date (the first valid one)."""
    store = F.trim(F.regexp_replace(F.trim("text"), r"^[\(\)주]+", ""))
    found = lines.where(F.col("line_idx") < date_lines).select("receipt_id", "line_idx", F.when(F.col("text").rlike(stores) & (F.col("line_idx") < store_lines), store).alias("s"), X.find_date(F.col("text"), HEAD_DATES).alias("d"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_idx")))
    return lines.select("receipt_id").distinct().join(found.groupBy("receipt_id").agg(first("s").alias("store_name"), first("d").alias("purchase_date")), "receipt_id", "left")
