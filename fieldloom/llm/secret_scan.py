"""Secret scans (DataFrame functions only).

Base patterns find assignments, access keys and long hexadecimal strings.  On
top of them a battery of randomness tests looks at every long token of the text:
its encoding is inferred, then tested for uniform use of that alphabet
(chi-squared over its symbols, and over vowels, common and other letters, digits and
signs), for runs of capitals, small letters, digits and signs (above and below the
median where an alphabet has one kind only), and for serial correlation; the four
p-values are combined by Fisher's method.  How large the combined
value must be is decided per encoding and length class by false-discovery control.

The control needs to know how random ordinary tokens of that encoding and length look
by chance.  Decoys show it.  Every text makes some, one for each ``STRETCH`` words and so
many that an encoding and length class gets about ``DECOYS`` or more: neighbouring words
from anywhere in the text, joined as names, paths, identifiers and codes are (run
together, capitalised, with numbers in between, with dashes, underscores or slashes; only
the letters a-f for hexadecimal ones) and cut to lengths of the class.  Texts of few words
are put together first.  Decoys come from whole short words in usual case only, so keys in
the corpus do not end up in them.  What is tested, and counted against the decoys, are
all tokens of all texts.

Defined results
---------------
* null and empty texts have no spans; repeated rows each give a row.
* a random token that overlaps a base span is not reported again.
* tokens have ``SHORTEST`` characters or more.  Where an encoding and length class has
  no threshold that keeps the false-discovery rate under ``FDR`` (short tokens of one
  case look much alike, random or not) it adds nothing; the base spans stay in any case.
* a table whose texts have no words yields no decoys and adds nothing.
* only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import once
from .spans import apart, matches, of_kind, ordered, written

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
KINDS = ("assign", "access", "hex")
RANDOM = "random"
FDR, BINS, SHORTEST = 0.01, 100, 12
#: Decoys of each encoding and length class at least, words that give one more, words that a text needs to make decoys by itself; texts with fewer that are put together, in so many pools at least.
DECOYS, STRETCH, ENOUGH, TOGETHER, POOLS = 1024, 128, 128, 64, 64
#: Length classes begin at these token lengths.
CLASSES = (12, 16, 20, 24, 32, 40, 64, 128)
#: Alphabets by encoding, in the order of their symbols' values, with what tells a token of them.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
KNOWN_BY = {
    "hex": "^(?:[0-9a-f]+|[0-9A-F]+)$",
    "lower": "^[a-z]+$",
    "upper": "^[A-Z]+$",
    "letters": "^[A-Za-z]+$",
    "base32": "^[A-Z2-7]+$",
    "lower36": "^[a-z0-9]+$",
    "upper36": "^[A-Z0-9]+$",
    "alnum": "^[A-Za-z0-9]+$",
    "base64url": "^[A-Za-z0-9_-]+$",
    "base64": "",
}
USUAL = "(?<![A-Za-z0-9+/_=-])(?:[A-Z]?[a-z]{1,11}|[A-Z]{2,12})(?![A-Za-z0-9+/_=-])"
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{SHORTEST},}}+={{0,2}}+"


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(
        matches(text, ASSIGN, text.rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*+[:=]")),
        lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 12,
    )
    return {
        "assign": assign,
        "access": matches(text, "AKIA[A-Z0-9]{14,}+", text.contains("AKIA")),
        "hex": matches(text, "[0-9a-f]{16,}+", text.rlike("[0-9a-f]{16}")),
    }


def _normal_above(z: Column) -> Column:
    """P(Z > z): the logistic-type approximation 1 / (1 + exp(1.5976 z + 0.070566 z^3))."""
    return 1 / (1 + F.exp(F.least(F.lit(500.0), 1.5976 * z + 0.070566 * z * z * z)))


def encoding_of(token: Column) -> Column:
    """The smallest alphabet that a token can be written in."""
    body = F.regexp_replace(token, "=+$", "")
    return once(body, lambda b: F.coalesce(*[F.when(b.rlike(p), e) if p else F.lit(e) for e, p in KNOWN_BY.items()]))


#: Letters by how common they are in words of Latin script.
VOWELS, COMMON = "aeiou", "nrstlhdc"
RUN = "[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"


def _shares(alphabet: str) -> list[float]:
    """Of a random token: the chance that the next symbol is of another kind, and the shares of vowels, common, other letters, digits and signs."""
    kinds = [sum(map(test, alphabet)) / len(alphabet) for test in (str.isupper, str.islower, str.isdigit, lambda c: not c.isalnum())]
    low = [c.lower() for c in alphabet]
    cells = [sum(c in VOWELS for c in low), sum(c in COMMON for c in low), sum(c.isalpha() and c not in VOWELS + COMMON for c in low), sum(c.isdigit() for c in low), sum(not c.isalnum() for c in low)]
    return [1 - sum(k * k for k in kinds), *(n / len(alphabet) for n in cells)]


def bin_of(token: Column, encoding: Column) -> Column:
    """The combined p-value of the battery in ``BINS`` steps."""
    body = F.regexp_replace(token, "=+$", "")
    known = F.create_map(*[x for e, a in ALPHABETS.items() for x in (F.lit(e), F.struct(F.lit(a).alias("alphabet"), F.array(*map(F.lit, _shares(a))).alias("shares")))])
    read = F.struct(F.when(encoding == "hex", F.lower(body)).otherwise(body).alias("value"), F.element_at(known, encoding).alias("known"))
    return F.floor(F.least(once(read, lambda r: _battery(r["value"], r["known"]["alphabet"], r["known"]["shares"])), F.lit(0.999999)) * BINS).cast("int")


def _above_chi(chi: Column, df: Column) -> Column:
    """P(chi-squared of ``df`` degrees > chi), by the cube root that is nearly normal; 1 without a degree of freedom."""
    d = F.greatest(df, F.lit(1.0))
    return F.when(df > 0, _normal_above((F.pow(F.greatest(chi, F.lit(0.0)) / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d)))).otherwise(1.0)


def _battery(value: Column, alphabet: Column, shares: Column) -> Column:
    """The p-value of four tests together: symbols and groups of symbols are used evenly, kinds of symbols change often enough, neighbours do not depend on each other."""
    n, k = F.length(value).cast("double"), F.length(alphabet).cast("double")
    middle, spread = (k + 1) / 2, (k * k - 1) / 12
    places = F.transform(F.split(value, ""), lambda c: F.call_function("instr", alphabet, c).cast("double"))
    pair = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = once(places, pair)
    # Of n symbols in order, each run of r equal ones adds r * r: the chi-squared statistic needs no more of the counts.
    squares = F.aggregate(
        F.sort_array(places),
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda t, x: once(F.when(t["last"] == x, t["run"] + 1).otherwise(F.lit(1.0)), lambda r: F.struct(x.alias("last"), r.alias("run"), (t["sum"] + 2 * r - 1).alias("sum"))),
        lambda t: t["sum"],
    )
    sums = F.aggregate(
        both,
        F.struct(F.lit(0.0).alias("changes"), F.lit(0.0).alias("products")),
        lambda t, p: F.struct((t["changes"] + ((p["a"] > middle) != (p["b"] > middle)).cast("double")).alias("changes"), (t["products"] + (p["a"] - middle) * (p["b"] - middle)).alias("products")),
    )
    without = lambda letters: n - F.length(F.translate(value, letters + letters.upper(), ""))
    digits = n - F.length(F.regexp_replace(value, "[0-9]", ""))
    letters = n - F.length(F.regexp_replace(value, "[A-Za-z]", ""))
    vowels, common = without(VOWELS), without(COMMON)
    cells = F.array(*[c.cast("double") for c in (vowels, common, letters - vowels - common, digits, n - letters - digits)])
    runs = F.regexp_count(value, F.lit(RUN)).cast("double")

    def combined(found: Column) -> Column:
        uniform = _above_chi(k / n * found["squares"] - n, k - 1)
        expected = F.slice(shares, 2, 5)
        coarse = F.aggregate(F.zip_with(found["cells"], expected, lambda o, e: F.when(e > 0, (o - n * e) * (o - n * e) / (n * e)).otherwise(0.0)), F.lit(0.0), lambda t, x: t + x)
        even = _above_chi(coarse, F.size(F.filter(expected, lambda e: e > 0)).cast("double") - 1)
        q = F.element_at(shares, 1)
        few = _normal_above(((n - 1) * q - (found["runs"] - 1)) / F.sqrt((n - 1) * q * (1 - q)))
        median = 2 * _normal_above(F.abs(found["sums"]["changes"] - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        serial = 2 * _normal_above(F.abs(found["sums"]["products"] / spread) / F.sqrt(n - 1))
        x = F.aggregate(F.array(uniform, even, F.when(q > 0.01, few).otherwise(median), serial), F.lit(0.0), lambda t, p: t - F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))))
        return once(x, lambda x: F.exp(-x) * (1 + x + x * x / 2 + x * x * x / 6))

    return once(F.struct(squares.alias("squares"), sums.alias("sums"), cells.alias("cells"), runs.alias("runs")), combined)


def length_class(n: Column) -> Column:
    return F.greatest(*[F.when(n >= c, c).otherwise(0) for c in CLASSES])


def _tokens(text: Column) -> Column:
    """Long tokens with their place, length class and encoding."""
    return F.transform(
        matches(text, TOKEN),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), length_class(s["end"] - s["start"]).alias("class"), encoding_of(s["hit"]).alias("encoding")),
    )


def _pools(docs: DataFrame, rows: int) -> DataFrame:
    """(seed, texts, words): the ordinary words of every text in their order, those of texts with few words put together; ``rows`` is the number of all texts."""
    each = docs.select(F.xxhash64("doc_id", "text").alias("seed"), F.regexp_extract_all("text", F.lit(USUAL), F.lit(0)).alias("words")).where(F.size("words") > 0)
    alone = F.size("words") >= ENOUGH
    few = each.where(~alone).groupBy(F.pmod("seed", F.lit(max(POOLS, rows // TOGETHER))).alias("pool")).agg(F.array_sort(F.collect_list(F.struct("seed", "words"))).alias("t"))
    together = few.select(F.xxhash64("pool").alias("seed"), F.size("t").alias("texts"), F.flatten(F.transform("t", lambda x: x["words"])).alias("words"))
    return each.where(alone).select("seed", F.lit(1).alias("texts"), "words").unionByName(together)


def _decoys(pools: DataFrame, rows: int, decoys: int = DECOYS) -> DataFrame:
    """(encoding, class, bin) of ordinary tokens: at least ``decoys`` tries for each encoding and length class over ``rows`` texts."""
    strata = [(e, c, top) for e in ALPHABETS for c, top in zip(CLASSES, (*CLASSES[1:], CLASSES[-1] + 32), strict=True)]
    table = F.array(*[F.struct(F.lit(e).alias("encoding"), F.lit(c).alias("class"), F.lit(top).alias("top")) for e, c, top in strata])
    draw = lambda i, salt, n: F.pmod(F.xxhash64("seed", i, F.lit(salt)), n).cast("int")
    digits = {"base32": "234567"}

    def token(s: Column, i: Column) -> Column:
        is_hex = s["encoding"] == "hex"
        size = s["class"] + draw(i, "size", s["top"] - s["class"])
        # Enough words for the longest token of the class, from anywhere in the pool and around its end.
        words = F.slice(F.col("twice"), draw(i, "at", F.size("words")) + 1, F.when(is_hex, size * 2 + 16).otherwise(F.floor(size / 2).cast("int") + 4))

        def spelled(words: Column) -> Column:
            number = F.lpad(draw(i, "number", F.lit(10000)).cast("string"), draw(i, "digits", F.lit(3)) + 1, "7")
            tall = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
            plain = F.lower(F.array_join(words, ""))
            cut = draw(i, "cut", F.lit(9)) + 2
            many = draw(i, "many", F.lit(4)) == 1

            def mixed(parts: Column, number: Column = number) -> Column:
                """A number once near the start, or behind every second word."""
                joined = F.array_join(parts, "")
                return F.when(many, F.array_join(F.transform(parts, lambda w, k: F.when(k % 2 == 1, F.concat(w, number)).otherwise(w)), "")).otherwise(F.concat(F.left(joined, cut), number, F.substring(joined, cut + 1, F.length(joined))))

            lower, upper = F.transform(words, F.lower), F.transform(words, F.upper)
            letters = F.regexp_replace(plain, "[^a-f]", "")
            code = F.upper(F.concat(F.left(letters, cut), number, F.substring(letters, cut + 1, F.length(letters))))
            low = F.translate(number, "0189", digits["base32"][:4])
            forms = {
                "hex": F.when(many, F.upper(letters)).otherwise(code), "lower": plain, "upper": F.upper(plain), "letters": F.array_join(tall, ""), "base32": mixed(upper, low), "lower36": mixed(lower),
                "upper36": mixed(upper), "alnum": mixed(tall), "base64url": F.call_function("array_join", F.when(many, tall).otherwise(lower), F.when(draw(i, "sign", F.lit(2)) == 0, "-").otherwise("_")),
                "base64": F.call_function("array_join", F.when(many, tall).otherwise(lower), F.when(draw(i, "sign", F.lit(4)) == 0, "+").otherwise("/")),
            }
            out = None
            for e, form in forms.items():
                out = (F if out is None else out).when(s["encoding"] == e, form)
            return F.left(out, size)

        return once(words, spelled)

    def made(i: Column) -> Column:
        def judge(x: Column) -> Column:
            fits = (F.length(x["t"]) >= x["s"]["class"]) & (encoding_of(x["t"]) == x["s"]["encoding"])
            return F.when(fits, F.struct(x["s"]["encoding"].alias("encoding"), x["s"]["class"].alias("class"), bin_of(x["t"], x["s"]["encoding"]).alias("bin")))

        return once(F.element_at(F.col("strata"), draw(i, "stratum", F.lit(len(strata))) + 1), lambda s: once(F.struct(token(s, i).alias("t"), s.alias("s")), judge))

    tries = F.greatest(F.col("texts") * -(-len(strata) * decoys // max(1, rows)), F.ceil(F.size("words") / STRETCH).cast("int"))
    # Few texts make many decoys each: they are dealt over tasks first.  Of more texts each makes its own where it stands.
    dealt = pools.repartition(POOLS, "seed") if rows < len(strata) * decoys else pools
    ready = dealt.withColumns({"twice": F.concat("words", F.reverse("words"), "words"), "strata": table})
    return ready.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), tries), made), lambda d: d.isNotNull())).alias("d")).select("d.*")


def thresholds(docs: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """Smallest accepted bin of the combined p-value per (encoding, length class); at most one entry each.

    Of the T tokens of a class at most T * (D(b) + 1) / (D + 1) ordinary ones are expected at or above bin b, where D
    counts decoys; that over the tokens found there is the false-discovery rate.  How many of the T are ordinary at
    most is read off the lower half of the bins, where random tokens add little to what ordinary ones show.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = docs.select(F.explode(F.transform(_tokens(text), lambda t: F.struct(t["encoding"].alias("encoding"), t["class"].alias("class"), bin_of(t["hit"], t["encoding"]).alias("bin")))).alias("t")).select("t.*")
    rows = docs.count()
    decoys = _decoys(_pools(docs, rows), rows)
    both = tokens.withColumn("decoy", F.lit(False)).unionByName(decoys.withColumn("decoy", F.lit(True)))
    counts = both.groupBy("encoding", "class", "bin").agg(F.count_if(~F.col("decoy")).alias("tokens"), F.count_if("decoy").alias("decoys"))
    stratum = ("encoding", "class")
    above = Window.partitionBy(*stratum).orderBy(F.desc("bin"))  # at most BINS rows each
    whole = Window.partitionBy(*stratum)
    low = lambda c: F.sum(F.when(F.col("bin") < BINS // 2, F.col(c)).otherwise(0)).over(whole)
    all_of = lambda c: F.sum(c).over(whole)
    ordinary = F.least(all_of("tokens"), (low("tokens") + 1) * all_of("decoys") / F.greatest(low("decoys"), F.lit(1)))
    rate = ordinary * (F.sum("decoys").over(above) + 1) / (all_of("decoys") + 1) / F.greatest(F.sum("tokens").over(above), F.lit(1))
    known = counts.withColumns({"rate": rate, "found": F.sum("tokens").over(above), "all_decoys": all_of("decoys")}).where("all_decoys > 0")
    least = known.where((F.col("rate") <= fdr) & (F.col("bin") >= 1) & (F.col("found") > 0)).groupBy(*stratum).agg(F.min("bin").alias("bin")).collect()
    return {(r["encoding"], r["class"]): r["bin"] for r in least}


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """(doc_id, text, base, spans): ordered spans (start, rank, end, kind) of each text."""
    least = thresholds(docs.select("doc_id", "text"), fdr)
    text = F.col("text")
    kinds = base_spans(text)
    # Only tokens of an encoding and class that have a threshold are put to the tests.
    limit = lambda s: F.coalesce(*[F.when((s["encoding"] == e) & (s["class"] == c), F.lit(b)) for (e, c), b in sorted(least.items())])
    passed = lambda s: once(limit(s), lambda b: F.when(b.isNotNull(), bin_of(s["hit"], s["encoding"]) >= b).otherwise(F.lit(False)))
    found = docs.select("doc_id", "text", ordered(*[of_kind(kinds[k], k, i) for i, k in enumerate(KINDS)]).alias("base"))
    if not least:
        return found.withColumn("spans", F.col("base"))
    return (
        found.withColumn("tested", F.filter(_tokens(text), passed))
        .withColumn("spans", ordered("base", of_kind(apart(F.col("tested"), F.col("base")), RANDOM, len(KINDS))))
        .drop("tested")
    )


def digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("base")["kind"], F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
