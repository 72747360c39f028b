"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides. All native."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch
from meshwalk.llm.common import lower_ascii, table

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
EMAIL, IP, CARD, PHONE, IBAN, SSN = range(6)
MARK, OTHER = "\x01", "\x02"

#: Gazetteers and context words (fixed values): parts of the labelers.
TLD = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|app|dev|uk|de|fr|es|it|nl|be|ch|at|pt|pl|se|no|dk|fi|ie|cz|ru|us|ca|mx|br|ar|cl|au|nz|jp|cn|in|kr|za|eu"
CALLING = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92|351|352|353|354|358|370|371|372|380|385|386|420|421|971|972"
ISSUER = "4|5[1-5]|2[2-7]|3[0-9]|6"
PRIVATE = r"0*(?:10|127|0)\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|2(?:2[4-9]|[3-5][0-9])\."
COUNTRY = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IT|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|TR"
CONTEXT = [
    "e-?mail|mail|contact|write|reach|correo|kontakt|courriel|adresse|contacto",
    "ip|host|server|client|address|from|dirección|adresse|serveur",
    "card|visa|mastercard|amex|credit|pay|paid|payment|tarjeta|karte|kreditkarte|carte",
    "phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms|text|teléfono|móvil|telefon|handy|téléphone|portable",
    "iban|account|bank|konto|cuenta|compte|banque|banco",
    "ssn|social|security|taxpayer",
]
AGAINST = "version|release|build|order|invoice|isbn|issn|chapter|section|figure|page|serial|model|part|ticket|price|seite|kapitel|rechnung|página|factura|pedido|facture|commande|rev|doi"

#: Base patterns. Those of the contract, written so that a search never walks a run of characters twice: a match starts where
#: a run starts, or where the last match ended, and gives no character back.
BASE = [
    (EMAIL, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    (IP, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (CARD, r"[0-9](?:[ -]?[0-9]){12,}+"),
    (PHONE, r"\+[0-9][ ().0-9-]+[0-9]"),
]
#: Further candidates: written around filters, without the international prefix, in other notations.
LOOSE = [
    (EMAIL, rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\[at\]|\(at\)|\{{at\}}|<at>) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{{dot\}}|<dot>|\.) ?[A-Za-z0-9-]++){{1,5}}+| at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){{0,4}} dot (?:{TLD})(?![A-Za-z0-9-]))"),
    (IP, r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    (CARD, r"(?<![0-9.])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9.])"),
    (PHONE, r"(?<![0-9A-Za-z+.-])(?<![0-9] )(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[ .-][0-9]))|(?<=\+[0-9]{1,3} )\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])"),
    (IBAN, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    (SSN, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
]
PATTERNS = [*BASE, *LOOSE]

NEAR = 32  # characters before a span that are looked at
VOTES = 5
ROUNDS = 60
BUCKETS = [7, len(PATTERNS), 128, 64, 36, 20]  # of the classifier's features: what the votes say, pattern, shape, word before, neighbours, digits


def _prefix(lens: Column) -> Column:
    """Running sums of an array, by stretches of 256."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / 256).cast("int")), lambda b: F.slice(lens, b * 256 + 1, F.lit(256)))
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, -1), F.lit(0)) + x))
    none = F.array().cast("array<int>")
    with_base = F.aggregate(cuts, F.struct(F.lit(0).alias("base"), none.alias("bases")), lambda s, c: F.struct((s["base"] + F.aggregate(c, F.lit(0), lambda a, x: a + x)).alias("base"), F.concat(s["bases"], F.array(s["base"])).alias("bases")))["bases"]
    inside = F.transform(cuts, lambda c: F.aggregate(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, F.lit(1)), grow))
    return F.flatten(F.zip_with(inside, with_base, lambda i, b: F.transform(i, lambda x: x + b)))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def one(k: Column) -> Column:
        d = F.substring(digits, n - k + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, k: a + F.coalesce(one(k), F.lit(0))) % 10 == 0


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))


def _mod97(c: Column) -> Column:
    bare = F.regexp_replace(c, " ", "")
    turned = F.split(F.concat(F.substring(bare, 5, 99), F.substring(bare, 1, 4)), "")
    digit = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(F.filter(turned, lambda x: x != ""), F.lit(0), lambda a, x: (a * F.when(digit(x) > 9, 100).otherwise(10) + digit(x)) % 97) == 1


def _strict(k: int, hit: Column) -> Column:
    """Whether a match of a base pattern stands."""
    if k == EMAIL:
        return F.lit(True)
    if k == IP:
        return _octets(hit)
    n = F.length(_digits(hit))
    return n.between(13, 19) & _luhn(_digits(hit)) if k == CARD else n.between(9, 15)


def _structure(k: int, hit: Column) -> Column:
    """The labeler of checksums and ranges."""
    n = F.length(_digits(hit))
    if k == EMAIL:
        good = lower_ascii(hit).rlike(r"[a-z]{2,}$")
    elif k == IP:
        good = F.when(hit.contains(":"), True).otherwise(_octets(hit))
    elif k == CARD:
        good = n.between(13, 19) & _luhn(_digits(hit))
    elif k == PHONE:
        return F.when(n.between(10, 13), 1).when(n.between(9, 15), 0).otherwise(-1)
    elif k == IBAN:
        good = _mod97(hit)
    else:
        good = ~hit.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(good, 1).otherwise(-1)


def _gazetteer(k: int, hit: Column) -> Column:
    if k == EMAIL:
        return F.when(lower_ascii(hit).rlike(rf"(?:\.|dot[\])}}>]? ?)(?:{TLD})$"), 1).otherwise(-1)
    if k == IP:
        return F.when(hit.rlike(rf"^(?:{PRIVATE})"), -1).otherwise(0)
    if k == CARD:
        return F.when(hit.rlike(rf"^(?:{ISSUER})"), 1).otherwise(-1)
    if k == PHONE:
        return F.when(hit.rlike(rf"^(?:\+|00)(?:{CALLING})"), 1).otherwise(0)
    if k == IBAN:
        return F.when(hit.rlike(rf"^(?:{COUNTRY})"), 1).otherwise(-1)
    return F.lit(0)


def _context(k: int, before: Column) -> Column:
    low = F.lower(before)
    last = F.regexp_extract(low, r"(\p{L}+)[^\p{L}]*$", 1)  # the word before
    return F.when(last.rlike(rf"^(?:{AGAINST})$"), -1).when(low.rlike(rf"(?<!\p{{L}})(?:{CONTEXT[k]})(?!\p{{L}})"), 1).otherwise(0)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: none, space, punctuation, letter, digit, other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[.,;:!?()\[\]<>\"']"), 2).when(c.rlike(r"\p{L}"), 3).when(c.rlike("[0-9]"), 4).otherwise(5)


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _candidate(number: int, k: int, base: bool, c: Column) -> Column:
    """A match (start, end, hit, before, after) as a candidate with its votes and features."""
    hit, left, right = c["hit"], _side(F.substring(c["before"], -1, 1)), _side(F.substring(c["after"], 1, 1))
    ok = _strict(k, hit) if base else F.lit(False)
    votes = [
        F.when(ok, 1).otherwise(-1) if base else F.lit(0),
        _structure(k, hit),
        _gazetteer(k, hit),
        _context(k, c["before"]),
        F.when((left <= 2) & (right <= 2), 1).otherwise(-1),
    ]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit, "[0-9]", "9"), "[A-Za-z]+", "a"), "9{5,}", "99999")
    word = F.regexp_extract(F.lower(c["before"]), r"(\p{L}+)[^\p{L}]*$", 1)
    features = [F.lit(number), _bucket(shape, BUCKETS[2]), _bucket(word, BUCKETS[3]), left * 6 + right, F.least(F.length(_digits(hit)), F.lit(19))]
    return F.struct(F.lit(k).alias("k"), c["start"].alias("start"), c["end"].alias("end"), ok.alias("base"), F.array(*[v.cast("int") for v in votes]).alias("votes"), F.array(*[f.cast("int") for f in features]).alias("features"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def candidate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, others): for every row the spans that the base patterns give, by kind and start, and all other
    candidates, which overlap none of them; each with its votes and features."""
    t = F.coalesce("text", F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.instr(t, MARK) > 0, F.replace(t, F.lit(MARK), F.lit(OTHER))).otherwise(t).alias("t"))
    d = d.withColumn("some", F.col("t").rlike("[0-9@]|(?i:dot)"))
    # a text is cut at the marks around its matches: gap, match, gap, match, ..., gap
    d = d.select("doc_id", *[F.when(F.col("some"), F.split(F.regexp_replace("t", p, f"{MARK}$0{MARK}"), MARK, -1)).alias(f"p{n}") for n, (_, p) in enumerate(PATTERNS)])
    names = [f"p{n}" for n in range(len(PATTERNS))]
    d = d.select("doc_id", *names, *[F.when(F.size(p) > 1, _prefix(F.transform(p, F.length))).alias(f"e{p}") for p in names])

    def matches(p: str) -> Column:
        parts, ends = F.col(p), F.col(f"e{p}")
        at = lambda j: F.struct(F.get(ends, j - 1).alias("start"), F.get(ends, j).alias("end"), F.get(parts, j).alias("hit"), F.substring(F.get(parts, j - 1), -NEAR, NEAR).alias("before"), F.substring(F.get(parts, j + 1), 1, 1).alias("after"))
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2)), at)).alias(p)

    d = d.select("doc_id", *[matches(p) for p in names])
    none = F.array().cast("array<struct<k:int,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>>")

    def candidates(n: int) -> Column:
        return F.coalesce(F.transform(names[n], lambda c: _candidate(n, PATTERNS[n][0], n < len(BASE), c)), none).alias(names[n])

    d = d.select("doc_id", *[candidates(n) for n in range(len(PATTERNS))])
    tried, loose = F.concat(*names[: len(BASE)]), F.concat(*names[len(BASE) :])
    d = d.select("doc_id", F.filter(tried, lambda c: c["base"]).alias("base"), F.concat(F.filter(tried, lambda c: ~c["base"]), loose).alias("others"))
    return d.select("doc_id", "base", F.filter("others", lambda c: ~F.exists("base", lambda b: _overlaps(c, b))).alias("others"))


def weigh_votes(patterns: list[tuple], rounds: int = ROUNDS, trust: float = 20.0) -> dict:
    """EM over the counts of vote patterns (kind, votes, count): two classes, each labeler with its own shares of -1, 0 and 1
    in either class, each kind with its own share of true spans.

    Begins with the majority; ``trust`` counts as so many votes that are mostly right, so that few candidates, or candidates
    of one class alone, do not turn the classes round. Returns the log odds of kinds ("prior") and votes ("votes")."""
    belief = {(k, v): 1 / (1 + math.exp(-sum(v))) for k, v, _ in patterns}
    prior, weights = {}, []
    for _ in range(rounds):
        mass = {k: [1.0, 1.0] for k in range(len(KINDS))}
        share = [[{-1: trust * (0.7 if not y else 0.1), 0: trust * 0.2, 1: trust * (0.1 if not y else 0.7)} for y in (0, 1)] for _ in range(VOTES)]
        for k, v, n in patterns:
            p = belief[k, v]
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                mass[k][y] += w
                for j, x in enumerate(v):
                    share[j][y][x] += w
        prior = {k: math.log(m[1] / m[0]) for k, m in mass.items()}
        weights = [{x: math.log(one[x] / sum(one.values())) - math.log(zero[x] / sum(zero.values())) for x in (-1, 0, 1)} for zero, one in share]
        belief = {(k, v): 1 / (1 + math.exp(-max(-30.0, min(30.0, prior[k] + sum(w[x] for w, x in zip(weights, v, strict=True)))))) for k, v, _ in patterns}
    return {"prior": prior, "votes": weights}


def _voted(c: Column, model: dict) -> Column:
    """Log odds of a candidate by its votes."""
    kinds = F.array(*[F.lit(float(model["prior"][k])) for k in range(len(KINDS))])
    return reduce(lambda a, b: a + b, [F.get(F.array(*[F.lit(float(w[x])) for x in (-1, 0, 1)]), F.get(c["votes"], F.lit(j)) + 1) for j, w in enumerate(model["votes"])], F.get(kinds, c["k"]))


def _features(c: Column, model: dict) -> list[Column]:
    return [(F.greatest(F.lit(-3), F.least(F.lit(3), F.round(_voted(c, model) / 3.0))) + 3).cast("int"), *[F.get(c["features"], F.lit(j)) for j in range(len(BUCKETS) - 1)]]


def train_classifier(spans: DataFrame, model: dict) -> dict:
    """Naive Bayes on the features of all candidates, each a true span with the probability that the votes give: log odds of
    the classes ("prior") and of every value of every feature ("values")."""
    f = spans.select((1 / (1 + F.exp(-_voted(F.col("c"), model)))).alias("p"), F.posexplode(F.array(*_features(F.col("c"), model))).alias("f", "x"))
    sums = {(r["f"], r["x"]): (r["one"], r["all"] - r["one"]) for r in f.groupBy("f", "x").agg(F.sum("p").alias("one"), F.count(F.lit(1)).alias("all")).collect()}  # at most sum(BUCKETS) rows
    total = [sum(s[y] for (f, _), s in sums.items() if f == 0) for y in (0, 1)]
    odds = lambda f, x, n: math.log((sums.get((f, x), (0, 0))[0] + 1) / (total[0] + n)) - math.log((sums.get((f, x), (0, 0))[1] + 1) / (total[1] + n))
    return {"prior": math.log((total[0] + 1) / (total[1] + 1)), "values": [[odds(f, x, n) for x in range(n)] for f, n in enumerate(BUCKETS)]}


def _decided(c: Column, model: dict, last: dict) -> Column:
    values = [F.get(F.array(*map(F.lit, v)), x) for v, x in zip(last["values"], _features(c, model), strict=True)]
    return reduce(lambda a, b: a + b, values, F.lit(last["prior"])) > 0


def _written(spans: Column) -> Column:
    name = lambda c: F.get(F.array(*map(F.lit, KINDS)), c["k"])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", name(c), c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Base spans are those of the four base patterns that pass their checks; they always stay and are what n_* and base_sha256
    tell. Matches that fail, and matches of looser patterns (addresses written around filters, telephone numbers without a
    country, IPv6, cards with other separators, IBAN, SSN) are further candidates. Five labelers vote on every candidate, base
    ones included: its pattern, checksums and ranges, gazetteers, the words before it, its neighbouring characters. EM over
    the counts of vote patterns of all documents gives each labeler's reliability, and with it each candidate's probability;
    a naive Bayes classifier over shapes, context words and neighbours, trained on those, takes or refuses each further
    candidate. Of overlapping further spans the first stays. Offsets count code points, ends are exclusive.

    Null and empty texts have no spans; texts of any length are read whole; every row is dealt with by itself, also when
    rows repeat or doc_ids are null; without candidates nothing is added; an empty table gives an empty result; other
    columns are ignored.
    """
    tables = Scratch(docs.sparkSession)
    d = tables.cut(candidate_spans(docs), "candidates")
    spans = d.select(F.explode(F.concat("base", "others")).alias("c"))
    counted = spans.groupBy("c.k", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds * 3 ** VOTES rows
    model = weigh_votes(sorted((r["k"], tuple(r["votes"]), r["n"]) for r in counted))
    last = train_classifier(spans, model)
    short = lambda a: F.transform(a, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end")))
    more = F.array_sort(short(F.filter("others", lambda c: _decided(c, model, last))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["k"] - b["k"]))
    apart = lambda a: F.aggregate(a, F.slice(a, 1, F.lit(1)), lambda s, c: F.when(c["start"] >= F.element_at(s, -1)["end"], F.concat(s, F.array(c))).otherwise(s))
    d = d.select("doc_id", short(F.col("base")).alias("base"), F.when(F.size("others") > 0, more).alias("more"))
    d = d.select("doc_id", "base", F.when(F.size("more") > 0, apart(F.col("more"))).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda c: c["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.coalesce(F.array_sort(F.concat("base", "more"), lambda a, b: F.when(a["k"] != b["k"], a["k"] - b["k"]).otherwise(a["start"] - b["start"])), F.col("base"))
    return d.select("doc_id", *[count(k) for k in range(4)], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def op11_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
