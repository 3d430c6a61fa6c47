"""News analytics: relevance, polarity, age-weighted sentiment and sector tags, over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.cols import fill, ladder, num

C = F.col

# Sector keywords.
SECTOR_KEYWORDS = {
    "banking": ["bank", "nbfc", "credit", "loan", "npa", "rbi", "interest rate"],
    "it": ["software", "it", "tech", "cloud", "saas", "ai", "infosys", "tcs", "wipro"],
    "pharma": ["pharma", "drug", "fda", "usfda", "api", "healthcare", "hospital"],
    "auto": ["automobile", "car", "ev", "electric vehicle", "suv", "two-wheeler"],
    "energy": ["oil", "gas", "power", "renewable", "solar", "wind", "coal", "crude"],
    "fmcg": ["fmcg", "consumer", "food", "beverage", "volume growth"],
    "metal": ["steel", "metal", "aluminium", "copper", "zinc", "mining"],
    "infra": ["infrastructure", "road", "highway", "construction", "cement"],
}

# Publication time formats, tried in order.
TIME_FORMATS = ("EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssZ", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def prepared(articles: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Title and summary as one text; the whole of it unless a length is asked for."""
    text = F.concat(C("title"), F.lit(". "), F.coalesce("summary", F.lit("")))
    return articles.withColumn("text", text if max_chars is None else F.substring(text, 1, max_chars))


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per word of each text: runs of letters, lower case."""
    words = F.split(F.lower(C(text)), r"[^\p{L}]+")
    return df.select(key, F.explode(words).alias("word")).filter("word <> ''")


def polarity(articles: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean polarity of the lexicon words of a text and its size as confidence.

    Words meet the lexicon in an equi join (broadcast when Spark's size check allows) and are
    summed per text before anything is exchanged; texts without any such word score 0 without confidence.
    """
    hits = (tokens(articles, key).join(lexicon, "word").groupBy(key)
            .agg(F.avg("polarity").alias("sentiment"), F.count(F.lit(1)).alias("hits")))
    out = articles.join(hits, key, "left")
    return out.withColumns({
        "confidence": F.abs(fill(C("sentiment"), 0)),
        "sentiment": fill(C("sentiment"), 0), "hits": F.coalesce("hits", F.lit(0))})


def scored_by(articles: DataFrame, scorer) -> DataFrame:
    """Polarity from a vectorised scorer (a pandas UDF text -> struct(sentiment, confidence))."""
    out = articles.withColumn("_p", scorer(C("text")))
    return out.withColumns({"sentiment": C("_p.sentiment"), "confidence": C("_p.confidence")}).drop("_p")


def recent(articles: DataFrame, as_of: str, hours: float) -> DataFrame:
    now = F.to_timestamp(F.lit(as_of))
    return articles.filter(C("published") > now - F.make_dt_interval(secs=F.lit(float(hours) * 3600).cast("decimal(18,6)"))).withColumn(
        "age_hours", (now.cast("double") - C("published").cast("timestamp").cast("double")) / 3600)


def capped(articles: DataFrame, by: list[str], n: int, key: str = "doc_id") -> DataFrame:
    """Newest n articles per group (the report's cap)."""
    w = Window.partitionBy(*by).orderBy(F.desc("published"), key)
    return articles.withColumn("_r", F.row_number().over(w)).filter(C("_r") <= n).drop("_r")


def weighted(articles: DataFrame, hours: float, min_confidence: float = 0.45) -> DataFrame:
    """Confident articles with weight max(0.05, exp(-age/window))."""
    age = F.greatest(num(0), C("age_hours"))
    return articles.filter(C("confidence") >= min_confidence).withColumn(
        "weight", F.greatest(num(0.05), F.exp(-age / max(1, hours))))


def label(df: DataFrame, score: str = "score") -> DataFrame:
    s = C(score)
    return df.withColumn("label", ladder([
        (s >= 70, "Strongly Bullish"), (s >= 58, "Bullish"), (s >= 42, "Neutral"), (s >= 30, "Bearish")],
        "Strongly Bearish"))


def summary(articles: DataFrame, symbols: DataFrame, by: str = "symbol") -> DataFrame:
    """Score, label and article count per symbol; neutral where there is nothing."""
    agg = articles.groupBy(by).agg(
        (F.sum(C("sentiment") * C("weight")) / F.sum("weight")).alias("_avg"),
        F.count(F.lit(1)).alias("article_count"))
    out = symbols.join(agg, by, "left")
    out = out.withColumns({"score": fill((C("_avg") + 1) / 2 * 100, 50),
                           "article_count": F.coalesce("article_count", F.lit(0))}).drop("_avg")
    return label(out)


def source_breakdown(articles: DataFrame, by: str = "symbol") -> DataFrame:
    """Mean sentiment per source on 0..100."""
    return articles.groupBy(by, "source").agg((F.avg("sentiment") * 50 + 50).alias("source_score"))


def source_map(articles: DataFrame, by: str = "symbol", score=lambda c: F.round(c, 1)) -> DataFrame:
    """The breakdown as one map per symbol (as many entries as there are sources)."""
    parts = source_breakdown(articles, by)
    return parts.groupBy(by).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("source", score(C("source_score")).alias("score"))))).alias("source_breakdown"))


def report(articles: DataFrame, shown: int = 8, by: str = "symbol", key: str = "doc_id") -> DataFrame:
    """The newest articles of each symbol as one array, newest first; only those shown are gathered."""
    rows = capped(articles, [by], shown, key)
    entry = F.struct((-C("published").cast("timestamp").cast("double")).alias("_age"), key, "sentiment", "source")
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("_age")).alias("articles"))


def short_name(symbol):
    return F.replace(F.replace(F.lower(symbol), F.lit("ind"), F.lit("")), F.lit("ltd"), F.lit(""))


def is_relevant(text, symbol):
    """Symbol in the text, or its short form when longer than three letters."""
    low, short = F.lower(text), short_name(symbol)
    return low.contains(F.lower(symbol)) | ((F.length(short) > 3) & low.contains(short))


def mentions(articles: DataFrame, symbols: DataFrame, key: str = "doc_id") -> DataFrame:
    """(article, symbol) pairs where a name occurs anywhere in the text, also inside a word.

    Texts become their distinct words. A name is looked up by one piece of it: of its pieces of
    GRAM letters (a shorter name is one piece) the one that the vocabulary holds least often.
    Words are cut only into pieces of lengths that names have, and only pieces some name asks for
    are kept; where one stands, the name is compared in place. Matching words lead back to the
    articles that use them, so no pair is lost and none is formed without a reason. Names of
    several words are anchored on the first one and checked against the whole text.
    """
    forms = F.array_distinct(F.array(F.lower("symbol"), F.when(
        F.length(short_name(C("symbol"))) > 3, short_name(C("symbol")))))
    names = symbols.select("symbol", F.explode(forms).alias("name")).filter("name is not null and name <> ''")
    names = names.withColumn("anchor", F.get(F.split("name", "\\s+"), F.lit(0)))
    used = articles.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), "\\s+"))).alias("word"))
    words = used.select("word").distinct()

    def pieces(text: str, size):
        """(gram, place) of every piece of `size` letters, places from 1."""
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
        return F.transform(places, lambda i: F.struct(C(text).substr(i, size).alias("gram"), i.alias("place")))

    anchors = names.select("anchor").distinct().withColumn("size", F.least(F.length("anchor"), F.lit(GRAM)))
    asked = anchors.select("anchor", "size", F.explode(pieces("anchor", C("size"))).alias("x")).select("anchor", "size", "x.gram", "x.place")
    sizes = anchors.agg(F.collect_set("size").alias("sizes"))  # one row of at most GRAM numbers
    cut = words.join(F.broadcast(sizes)).select("word", F.explode(F.flatten(F.transform("sizes", lambda n: pieces("word", n)))).alias("x"))
    cut = cut.select("word", "x.gram", "x.place")
    counts = cut.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counts, "gram", "left").groupBy("anchor").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "place", "gram")).alias("x")).select("anchor", "x.gram", C("x.place").alias("offset"))
    found = (cut.join(rarest, "gram").filter(C("word").substr(C("place") - C("offset") + 1, F.length("anchor")) == C("anchor"))
             .select("word", "anchor").distinct())
    pairs = used.join(found, "word").select(key, "anchor").distinct().join(names, "anchor")
    whole = pairs.filter(C("name") == C("anchor")).select(key, "symbol")
    phrases = pairs.filter(C("name") != C("anchor")).select(key, "symbol", "name").distinct()
    phrases = phrases.join(articles.select(key, "text"), key).filter(F.lower("text").contains(C("name")))
    return whole.unionByName(phrases.select(key, "symbol")).distinct()


GRAM = 4


def sector_tags(articles: DataFrame, key: str = "doc_id", keywords: dict | None = None) -> DataFrame:
    """Sectors of an article by whole keywords; one-word keywords by a word join, phrases by search."""
    keywords = keywords or SECTOR_KEYWORDS
    pairs = [(w, sector) for sector, words in keywords.items() for w in words]
    single = [(w, s) for w, s in pairs if w.isalpha()]
    spark = articles.sparkSession
    table = F.broadcast(spark.createDataFrame(single, "word string, sector string"))  # a few dozen rows
    by_word = tokens(articles, key).join(table, "word").select(key, "sector", "word")
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\p{L}-]+", " "), F.lit(" "))
    phrases = F.array(*[
        F.when(low.contains(f" {w} "), F.struct(F.lit(s).alias("sector"), F.lit(w).alias("word")))
        for w, s in pairs if not w.isalpha()])
    by_phrase = (articles.select(key, F.explode(F.filter(phrases, lambda p: p.isNotNull())).alias("_p"))
                 .select(key, "_p.sector", "_p.word"))
    found = by_word.unionByName(by_phrase).distinct()
    return found.groupBy(key, "sector").agg(F.count(F.lit(1)).alias("keywords"))


def parsed_time(df: DataFrame, text: str = "published_text") -> DataFrame:
    """Publication time by the first format that fits; zone dropped, null when none fits."""
    tried = []
    for fmt in TIME_FORMATS:
        body = C(text)
        if fmt.startswith("EEE"):  # Spark does not parse day names; the date does not need them
            body, fmt = F.regexp_replace(body, "^[A-Za-z]{3}, ", ""), fmt.replace("EEE, ", "")
        if fmt.endswith("Z"):
            body = F.when(body.rlike("[+-][0-9]{2}:?[0-9]{2}$"), F.rtrim(F.regexp_replace(body, "[+-][0-9]{2}:?[0-9]{2}$", "")))
            fmt = fmt[:-1].rstrip()
        tried.append(F.try_to_timestamp(body, F.lit(fmt)).cast("timestamp_ntz"))
    return df.withColumn("published", F.coalesce(*tried))
