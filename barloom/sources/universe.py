"""Named symbol sets, aliases and size buckets, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Members of the index sets, and symbols that later left the exchange.
LARGE = """
RELIANCE TCS HDFCBANK INFY ICICIBANK HINDUNILVR SBIN BHARTIARTL ITC KOTAKBANK LT AXISBANK BAJFINANCE MARUTI
SUNPHARMA TITAN HCLTECH WIPRO ULTRACEMCO NESTLEIND TECHM POWERGRID NTPC COALINDIA ONGC M&M BAJAJFINSV DIVISLAB
GRASIM DRREDDY ADANIENT ADANIPORTS APOLLOHOSP ASIANPAINT BAJAJ-AUTO BPCL BRITANNIA CIPLA EICHERMOT HDFCLIFE
HEROMOTOCO HINDALCO INDUSINDBK JSWSTEEL LTIM SBILIFE SHREECEM TATAMOTORS TATACONSUM TATASTEEL
""".split()
MID = """
MPHASIS PERSISTENT COFORGE LTIM TATAELXSI PAYTM NYKAA IRCTC CDSL HAL BEL BHEL NMDC SAIL MOIL NATIONALUM HINDZINC
POLYCAB HAVELLS CROMPTON VOLTAS BLUESTARCO PIDILITIND BERGERPAINTS KANSAINER ABBINDIA SIEMENS ABB CUMMINSIND
THERMAX AUROPHARMA LUPIN TORNTPHARM ALKEM IPCALAB NATCOPHARM BANDHANBNK FEDERALBNK IDFCFIRSTB RBLBANK CANBK
UNIONBANK BANKBARODA PNB MAHABANK UCOBANK ZEEL PVRINOX INOXWIND KAYNES DIXON AMBER TATACHEM DEEPAKNTR PIIND
CHOLAFIN MANAPPURAM MUTHOOTFIN BAJAJHLDNG SBICARD HDFCAMC MFSL AAVAS NAUKRI JUSTDIAL INDIAMART MOTHERSON
BALKRISIND APOLLOTYRE CEAT MRF TVSMOTOR ASHOKLEY ESCORTS MAHINDCIE GLAND LICI METROPOLIS THYROCARE LALPATHLAB
KARURVYSYA DCBBANK JSWENERGY TORNTPOWER ADANIGREEN ADANIPOWER TATAPOWER NHPC SJVN IRFC RECLTD PFC HUDCO MARICO
DABUR EMAMILTD GODREJCP COLPAL TRENT ABFRL VEDL HINDCOPPER
""".split()
DELISTED = """
YESBANK RBLBANK DHFL ILFSTRANS RCOM IDEA UNITECH JAYPEEINFRA HDIL JETAIRWAYS RELINFRA LANCO MTNL JSWISPAT
SPICEJET SUCROSA
""".split()
# Symbols whose feed name is not the symbol with the default suffix.
ALIASES = {"BERGERPAINTS": "BERGEPAINT.NS", "BERGER": "BERGEPAINT.NS", "ESCORTS": "ESCORTSKUBOTA.NS"}
SUFFIX = ".NS"

SETS = {"large": LARGE, "broad": [*LARGE, *MID], "broad_unbiased": [*LARGE, *MID, *DELISTED], "mid": MID}


def universe_table(spark: SparkSession, sets: dict[str, list[str]] = SETS) -> DataFrame:
    """(name, symbol), each pair once."""
    rows = [(name, symbol) for name, symbols in sets.items() for symbol in symbols]
    return spark.createDataFrame(rows, "name string, symbol string").distinct()


def in_universe(df: DataFrame, universe: DataFrame, name: str) -> DataFrame:
    """Rows whose symbol belongs to the named set. Spark broadcasts the set if its size allows."""
    return df.join(universe.filter(C("name") == name).select("symbol"), "symbol", "left_semi")


def size_bucket(df: DataFrame, universe: DataFrame, large: str = "large", mid: str = "mid") -> DataFrame:
    """large / mid / small by membership."""
    ranks = universe.filter(C("name").isin(large, mid)).groupBy("symbol").agg(
        F.min(F.when(C("name") == large, 0).otherwise(1)).alias("_k"))
    return df.join(ranks, "symbol", "left").withColumn(
        "size_bucket", F.when(C("_k") == 0, "large").when(C("_k") == 1, "mid").otherwise("small")).drop("_k")


def feed_names(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Feed name of each symbol: itself when it has a suffix, its alias, or the default suffix added."""
    return df.join(aliases, "symbol", "left").withColumn("feed_name", F.when(
        C("symbol").contains("."), C("symbol")).otherwise(
        F.coalesce("alias", F.concat("symbol", F.lit(SUFFIX))))).drop("alias")


def alias_table(spark: SparkSession, aliases: dict[str, str] = ALIASES) -> DataFrame:
    return spark.createDataFrame(list(aliases.items()), "symbol string, alias string")
