"""Currency reference and currency resolution.

The seed below is an ISO-4217 subset with the symbols statements print. Callers
with a fuller dataset pass their own frame of the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Code, numeric code, fraction digits, English symbol, Ukrainian
# symbol, English name, Ukrainian name, further symbols.
CURRENCIES = (
    ("AUD", 36, 2, "A$", "AUD", "Australian Dollar", "австралійський долар", ["$"]),
    ("BGN", 975, 2, "BGN", "BGN", "Bulgarian Lev", "болгарський лев", ["лв"]),
    ("BRL", 986, 2, "R$", "BRL", "Brazilian Real", "бразильський реал", []),
    ("CAD", 124, 2, "CA$", "CAD", "Canadian Dollar", "канадський долар", ["$"]),
    ("CHF", 756, 2, "CHF", "CHF", "Swiss Franc", "швейцарський франк", ["Fr"]),
    ("CNY", 156, 2, "CN¥", "CNY", "Chinese Yuan", "китайський юань", ["¥", "元"]),
    ("CZK", 203, 2, "CZK", "CZK", "Czech Koruna", "чеська крона", ["Kč"]),
    ("DKK", 208, 2, "DKK", "DKK", "Danish Krone", "данська крона", ["kr"]),
    ("EUR", 978, 2, "€", "EUR", "Euro", "євро", ["€"]),
    ("GBP", 826, 2, "£", "GBP", "British Pound", "англійський фунт", ["£"]),
    ("GEL", 981, 2, "GEL", "GEL", "Georgian Lari", "грузинський ларі", ["₾"]),
    ("HUF", 348, 2, "HUF", "HUF", "Hungarian Forint", "угорський форинт", ["Ft"]),
    ("ILS", 376, 2, "₪", "ILS", "Israeli New Shekel", "новий ізраїльський шекель", []),
    ("INR", 356, 2, "₹", "INR", "Indian Rupee", "індійська рупія", []),
    ("JPY", 392, 0, "¥", "JPY", "Japanese Yen", "японська єна", ["¥"]),
    ("KWD", 414, 3, "KWD", "KWD", "Kuwaiti Dinar", "кувейтський динар", []),
    ("KZT", 398, 2, "KZT", "KZT", "Kazakhstani Tenge", "казахстанський тенге", ["₸"]),
    ("MDL", 498, 2, "MDL", "MDL", "Moldovan Leu", "молдовський лей", []),
    ("NOK", 578, 2, "NOK", "NOK", "Norwegian Krone", "норвезька крона", ["kr"]),
    ("PLN", 985, 2, "PLN", "PLN", "Polish Zloty", "польський злотий", ["zł"]),
    ("RON", 946, 2, "RON", "RON", "Romanian Leu", "румунський лей", ["lei"]),
    ("SEK", 752, 2, "SEK", "SEK", "Swedish Krona", "шведська крона", ["kr"]),
    ("TRY", 949, 2, "TRY", "TRY", "Turkish Lira", "турецька ліра", ["₺"]),
    ("UAH", 980, 2, "UAH", "₴", "Ukrainian Hryvnia", "українська гривня", ["₴", "грн"]),
    ("USD", 840, 2, "$", "USD", "US Dollar", "долар США", ["$"]),
)

# Locale to currency.
LOCALES = (
    ("de_DE", "EUR"),
    ("en_GB", "GBP"),
    ("en_US", "USD"),
    ("es_ES", "EUR"),
    ("fr_FR", "EUR"),
    ("ja_JP", "JPY"),
    ("pl_PL", "PLN"),
    ("uk_UA", "UAH"),
)

_SCHEMA = (
    "code string, numeric_code int, fraction_digits int, symbol_en string, symbol_uk string, "
    "name_en string, name_uk string, special array<string>, pos int"
)


def currency_frame(spark: SparkSession) -> DataFrame:
    rows = [(*c, i) for i, c in enumerate(CURRENCIES)]
    return spark.createDataFrame(rows, _SCHEMA)


def locale_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LOCALES), "locale string, code string")


def symbol_claims(currencies: DataFrame) -> DataFrame:
    """Every (symbol, code) pair with the pass in which the code claims it.

    Exact symbols claim before special ones, then dataset order decides.
    """
    exact = F.array(F.col("symbol_en"), F.col("symbol_uk"))
    both = F.concat(
        F.transform(exact, lambda s: F.struct(s.alias("symbol"), F.lit(1).alias("pass"))),
        F.transform("special", lambda s: F.struct(s.alias("symbol"), F.lit(2).alias("pass"))),
    )
    return (
        currencies.select("code", "pos", F.explode(both).alias("c"))
        .select("c.symbol", "code", "c.pass", "pos")
        .groupBy("symbol", "code")
        .agg(F.min(F.struct("pass", "pos")).alias("claim"))
    )


def symbol_owner(currencies: DataFrame) -> DataFrame:
    """One code per symbol: the first claim."""
    first = W.partitionBy("symbol").orderBy("claim")
    return (
        symbol_claims(currencies)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("symbol", "code")
    )


def ambiguous_symbols(currencies: DataFrame) -> DataFrame:
    return (
        symbol_claims(currencies)
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("codes"))
        .where("codes > 1")
    )


def lookup_maps(currencies: tuple = CURRENCIES) -> dict[str, dict]:
    """The reference as plain dicts, for use as literal maps in a plan.

    The currency list is a bounded dimension (ISO-4217 has fewer than 200
    active codes), so a literal map replaces a join on transaction rows.
    """
    codes = {c[0]: c[0] for c in currencies}
    numeric: dict[str, str] = {}
    owners: dict[str, str] = {}
    claims: dict[str, set[str]] = {}
    for code, num, _, en, uk, _, _, special in currencies:
        numeric.setdefault(str(num), code)
        for s in {en, uk, *special}:
            claims.setdefault(s, set()).add(code)
        for s in (en, uk):
            owners.setdefault(s, code)
    for code, *_, special in currencies:
        for s in special:
            owners.setdefault(s, code)
    ambiguous = {s: True for s, c in claims.items() if len(c) > 1}
    return {"code": codes, "numeric": numeric, "symbol": owners, "ambiguous": ambiguous}


def frame_maps(currencies: DataFrame) -> dict[str, dict]:
    """``lookup_maps`` of a table shaped like ``currency_frame``, in order of ``pos``.

    The table is the currency standard, a bounded dimension, and is read once.
    """
    *fields, pos = (c.split()[0] for c in _SCHEMA.split(", "))
    return lookup_maps(tuple(tuple(r) for r in currencies.orderBy(pos).select(*fields).collect()))


def literal_map(mapping: dict) -> Column:
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def get(mapping: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


def symbol_to_iso(text: Column, maps: dict | None = None) -> Column:
    maps = maps or lookup_maps()
    return F.coalesce(get(maps["code"], text), get(maps["symbol"], text))


def resolve_currency(mode: Column, code: Column, column: Column, base: Column) -> Column:
    """Option `code` wins, `use_base` is the base, `auto` reads the column.

    Null marks text that names no known currency.
    """
    return (
        F.when(mode == "code", code)
        .when(mode == "use_base", base)
        .when(column.isNull() | (column == ""), base)
        .otherwise(symbol_to_iso(column))
    )


def format_amount(amount: Column, digits: Column, symbol: Column, lang: str = "en") -> Column:
    """Grouped amount with the currency's fraction digits and its symbol.

    Ukrainian output uses a no-break space for groups and a decimal comma.
    """
    options = sorted({c[2] for c in CURRENCIES})
    text = F.coalesce(*[F.when(digits == d, F.format_number(amount, d)) for d in options])
    if lang == "uk":
        text = F.translate(text, ",.", "\u00a0,")
    return F.concat(text, F.lit(" "), symbol)


def locale_to_currency(locale: Column) -> Column:
    return get(dict(LOCALES), F.replace(locale, F.lit("-"), F.lit("_")))
