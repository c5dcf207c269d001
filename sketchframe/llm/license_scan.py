"""License signatures: ordered regular expressions behind a keyword prefilter, in DataFrame functions only.

``rules`` lists several hundred expressions.  Each has a keyword; a text is searched by a rule only if it contains
the keyword, and texts without any keyword (nearly all) are looked at once.  A hit is the span of a match in
characters.  Hits are taken in order of start, the longer first, then priority: a hit that lies inside the span of one of
equal or better priority is suppressed, and the labels of the others are reported.  Everything happens within
a row, so nothing is exchanged and a hot license line costs what its text costs.

The base looks for four phrases as consecutive words and counts all places; its labels always stay.

Defined cases: a null text is an empty one, with no words and no labels.  Repeated rows give equal rows; other columns
are not read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchframe.llm.common import texts

# The base phrases, their labels, and what separates words.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """A signature: texts are lower-cased (A-Z); priority 1 is the best of three.

    The keyword has no white space unless the expression has the same, so that no match escapes it.
    """

    keyword: str
    regex: str
    label: str
    priority: int


def _version(number: str) -> str:
    """How a version is written: 3, 3.0, v3, version 3.0."""
    whole = number.removesuffix(".0").replace(".", "\\.")
    tail = "(?:\\.0)?" if number.endswith(".0") or "." not in number else ""
    return f"(?:,?\\s+)?(?:version\\s+|v\\.?\\s?|-)?{whole}{tail}(?![0-9.]*[0-9])"


# (label, keyword, name as an expression, versions)
_FAMILIES = [
    ("agpl", "affero", "(?:gnu\\s+)?affero\\s+general\\s+public\\s+licen[cs]e", ["1.0", "3.0"]),
    ("lgpl", "lesser", "(?:gnu\\s+)?lesser\\s+general\\s+public\\s+licen[cs]e", ["2.1", "3.0"]),
    ("lgpl", "library", "(?:gnu\\s+)?library\\s+general\\s+public\\s+licen[cs]e", ["2.0"]),
    ("gpl", "general", "gnu\\s+general\\s+public\\s+licen[cs]e", ["1.0", "2.0", "3.0"]),
    ("gfdl", "documentation", "(?:gnu\\s+)?free\\s+documentation\\s+licen[cs]e", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", "apache(?:\\s+software)?\\s+licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", "mozilla\\s+public\\s+licen[cs]e", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", "eclipse\\s+public\\s+licen[cs]e", ["1.0", "2.0"]),
    ("eupl", "european", "european\\s+union\\s+public\\s+licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("cddl", "distribution", "common\\s+development\\s+and\\s+distribution\\s+licen[cs]e", ["1.0", "1.1"]),
    ("cpl", "common", "common\\s+public\\s+licen[cs]e", ["1.0"]),
    ("osl", "software", "open\\s+software\\s+licen[cs]e", ["1.0", "1.1", "2.0", "2.1", "3.0"]),
    ("afl", "academic", "academic\\s+free\\s+licen[cs]e", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("artistic", "artistic", "(?:perl\\s+)?artistic\\s+licen[cs]e", ["1.0", "2.0"]),
    ("boost", "boost", "boost\\s+software\\s+licen[cs]e", ["1.0"]),
    ("bsl", "business", "business\\s+source\\s+licen[cs]e", ["1.0", "1.1"]),
    ("sspl", "server", "server\\s+side\\s+public\\s+licen[cs]e", ["1.0"]),
    ("ofl", "font", "(?:sil\\s+)?open\\s+font\\s+licen[cs]e", ["1.0", "1.1"]),
    ("odbl", "database", "open\\s+database\\s+licen[cs]e", ["1.0"]),
    ("odc-by", "commons", "open\\s+data\\s+commons\\s+attribution\\s+licen[cs]e", ["1.0"]),
    ("zpl", "zope", "zope\\s+public\\s+licen[cs]e", ["1.1", "2.0", "2.1"]),
    ("upl", "permissive", "universal\\s+permissive\\s+licen[cs]e", ["1.0"]),
    ("python", "python", "python\\s+software\\s+foundation\\s+licen[cs]e", ["2.0"]),
    ("ms-pl", "microsoft", "microsoft\\s+public\\s+licen[cs]e", []),
    ("ms-rl", "microsoft", "microsoft\\s+reciprocal\\s+licen[cs]e", []),
    ("mit", "mit", "(?<![a-z0-9])mit\\s+licen[cs]e", []),
    ("isc", "isc", "(?<![a-z0-9])isc\\s+licen[cs]e", []),
    ("zlib", "zlib", "zlib(?:/libpng)?\\s+licen[cs]e", []),
    ("ncsa", "ncsa", "(?:university\\s+of\\s+illinois/)?ncsa\\s+(?:open\\s+source\\s+)?licen[cs]e", []),
    ("wtfpl", "want", "do\\s+what\\s+the\\s+[a-z*]+\\s+you\\s+want\\s+to\\s+public\\s+licen[cs]e", []),
    ("beerware", "beer", "beer-?ware\\s+licen[cs]e", []),
    ("x11", "x11", "x11\\s+licen[cs]e", []),
    ("postgresql", "postgresql", "postgresql\\s+licen[cs]e", []),
    ("php", "php", "php\\s+licen[cs]e", ["3.0", "3.01"]),
    ("ruby", "ruby", "ruby\\s+licen[cs]e", []),
    ("openssl", "openssl", "openssl\\s+licen[cs]e", []),
    ("unlicense", "unlicense", "(?<![a-z0-9])the\\s+unlicense", []),
]

# (label, keyword, expression, priority): sentences of license texts and links to them.
_SENTENCES = [
    ("mit", "charge", "permission\\s+is\\s+hereby\\s+granted,?\\s+free\\s+of\\s+charge,?\\s+to\\s+any\\s+person\\s+obtaining\\s+a\\s+copy", 1),
    ("isc", "permission", "permission\\s+to\\s+use,\\s+copy,\\s+modify,\\s+and(?:/or)?\\s+distribute\\s+this\\s+software\\s+for\\s+any\\s+purpose\\s+with\\s+or\\s+without\\s+fee", 1),
    ("bsd-3-clause", "endorse", "neither\\s+the\\s+names?\\s+of\\s+[\\s\\S]{1,2000}?\\s+endorse\\s+or\\s+promote\\s+products", 1),
    ("bsd-2-clause", "redistribution", "redistribution\\s+and\\s+use\\s+in\\s+source\\s+and\\s+binary\\s+forms,?\\s+with\\s+or\\s+without", 2),
    ("bsd-4-clause", "advertising", "all\\s+advertising\\s+materials\\s+mentioning\\s+features", 1),
    ("zlib", "as-is", "provided\\s+'as-is',?\\s+without\\s+any\\s+express\\s+or\\s+implied\\s+warranty", 2),
    ("unlicense", "domain", "free\\s+and\\s+unencumbered\\s+software\\s+released\\s+into\\s+the\\s+public\\s+domain", 1),
    ("public-domain", "domain", "(?:dedicated|released|placed)\\s+(?:in)?to\\s+the\\s+public\\s+domain", 2),
    ("cc0", "cc0", "(?<![a-z0-9])cc0(?:[ -]1\\.0)?(?![a-z0-9])", 2),
    ("cc0", "publicdomain/zero", "creativecommons\\.org/publicdomain/zero/1\\.0", 1),
    ("apache", "apache.org/licenses", "apache\\.org/licenses/license-2\\.0", 1),
    ("gpl", "gnu.org/licenses", "gnu\\.org/licenses/(?:old-licenses/)?gpl", 1),
    ("lgpl", "gnu.org/licenses", "gnu\\.org/licenses/(?:old-licenses/)?lgpl", 1),
    ("agpl", "gnu.org/licenses", "gnu\\.org/licenses/agpl", 1),
    ("mit", "opensource.org", "opensource\\.org/licenses/mit", 1),
    ("mpl", "mozilla.org/mpl", "mozilla\\.org/mpl", 1),
    ("epl", "eclipse.org/legal", "eclipse\\.org/legal/epl", 1),
    ("boost", "boost.org", "boost\\.org/license_1_0", 1),
    ("all-rights-reserved", "reserved", "(?<![a-z0-9])all\\s+rights\\s+reserved", 3),
    ("proprietary", "proprietary", "proprietary\\s+and\\s+confidential", 3),
    ("bsd", "bsd", "(?:new|modified|revised|simplified)\\s+bsd\\s+licen[cs]e", 2),
    ("bsd-2-clause", "bsd", "(?:2|two)-clause\\s+(?:simplified\\s+)?bsd|bsd[ -](?:2|two)-clause", 1),
    ("bsd-3-clause", "bsd", "(?:3|three)-clause\\s+(?:new\\s+|modified\\s+)?bsd|bsd[ -](?:3|three)-clause", 1),
    ("bsd-4-clause", "bsd", "(?:4|four)-clause\\s+(?:original\\s+)?bsd|bsd[ -](?:4|four)-clause", 1),
    ("bsd", "bsd", "(?<![a-z0-9])bsd\\s+licen[cs]e", 3),
]

# Creative Commons: elements as written in short and in full.
_COMMONS = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by-sa", "attribution-share\\s?alike"),
    "cc-by-nc": ("by-nc", "attribution-non-?commercial"),
    "cc-by-nd": ("by-nd", "attribution-no-?deriv(?:ative)?s?"),
    "cc-by-nc-sa": ("by-nc-sa", "attribution-non-?commercial-share\\s?alike"),
    "cc-by-nc-nd": ("by-nc-nd", "attribution-non-?commercial-no-?deriv(?:ative)?s?"),
}
_COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def rules() -> list[Rule]:
    """All signatures in order; families give a named, a versioned and a tagged form each."""
    made = [Rule(keyword, regex, label, priority) for label, keyword, regex, priority in _SENTENCES]
    for label, keyword, name, versions in _FAMILIES:
        made.append(Rule(keyword, f"(?<![a-z0-9]){name}", label, 2))
        made.append(Rule(keyword, f"(?:licen[cs]ed|released|distributed|available)\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?{name}", label, 2))
        for number in versions:
            kept = number.removesuffix(".0")
            made.append(Rule(keyword, f"(?<![a-z0-9]){name}{_version(number)}", f"{label}-{kept}", 1))
        for number in versions or [""]:
            tag = re_tag(label, number)
            kept = f"-{number.removesuffix('.0')}" if number else ""
            made.append(Rule("spdx", f"spdx-license-identifier:\\s*{tag}(?![a-z0-9.]*[a-z0-9])", label + kept, 1))
            if number and label in ("gpl", "lgpl", "agpl", "gfdl"):
                made.append(Rule("spdx", f"spdx-license-identifier:\\s*{tag}-only", f"{label}{kept}-only", 1))
                made.append(Rule("spdx", f"spdx-license-identifier:\\s*{tag}-or-later", f"{label}{kept}-or-later", 1))
                made.append(Rule(keyword, f"(?:gnu\\s+)?(?<![a-z0-9]){name}{_version(number)},?\\s+or\\s+(?:\\(at\\s+your\\s+option\\)\\s+)?any\\s+later", f"{label}{kept}-or-later", 1))
    for label, (short, long) in _COMMONS.items():
        after = "(?!-(?:sa|nc|nd))"
        forms = [(f"cc{mark}by", f"(?<![a-z0-9])cc{mark}{short.replace('-', '[ -]')}") for mark in " -"]
        for keyword, form in forms:
            made.append(Rule(keyword, f"{form}{after}(?![a-z0-9])", label, 2))
        made.append(Rule("creative", f"creative\\s+commons\\s+{long}(?!-)", label, 2))
        for number in _COMMONS_VERSIONS:
            number_ = number.replace(".", "\\.")
            for keyword, form in forms:
                made.append(Rule(keyword, f"{form}[ -]{number_}", f"{label}-{number}", 1))
            made.append(Rule("creativecommons.org", f"creativecommons\\.org/licenses/{short}/{number_}", f"{label}-{number}", 1))
            made.append(Rule("creative", f"creative\\s+commons\\s+{long}[ -]{number_}", f"{label}-{number}", 1))
    return made


def re_tag(label: str, number: str) -> str:
    """An SPDX identifier as an expression; the version may lack its .0."""
    if not number:
        return label
    whole, tail = number.removesuffix(".0").replace(".", "\\."), "(?:\\.0)?" if number.endswith(".0") else ""
    return f"{label}-{whole}{tail}"


# --- expressions ------------------------------------------------------------


def lowered(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def spaced_words(text: Column) -> Column:
    """The lower-cased words with one blank before each and after the last; a blank alone for none."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), _BETWEEN, " ")


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def phrase_places(spaced: Column, phrase: str) -> Column:
    """How often ``phrase`` occurs, and the index of the word at its first and last place."""
    parts = F.split(spaced, f"(?<= ){phrase}(?= )")
    times = F.size(parts) - 1
    # the blank before the first word counts, so word k has k + 1 blanks before it
    first = _blanks(F.element_at(parts, 1)) - 1
    last = _blanks(spaced) - _blanks(F.element_at(parts, -1)) - (len(phrase.split()) - 1) - 1
    some = times > 0
    return F.struct(
        times.cast("bigint").alias("times"), F.when(some, first).cast("bigint").alias("first"), F.when(some, last).cast("bigint").alias("last")
    )


_BASE = "array<struct<label:string,at:struct<times:bigint,first:bigint,last:bigint>>>"
_HIT = "array<struct<start:int,stop:int,priority:int,rule:int,label:string>>"


def _spans(text: Column, rule: Column) -> Column:
    """Hits of one rule: its matches, placed by the lengths of what lies between them."""
    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    between = F.split(text, rule["regex"], -1)
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("long")))

    def follow(state: Column, size: Column) -> Column:
        start = state["next"] + size["gap"]
        hit = F.struct(start.alias("start"), (start + size["long"]).alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct((start + size["long"]).alias("next"), F.array_append(state["hits"], hit).alias("hits"))

    begin = F.struct(F.lit(0).alias("next"), F.array().cast(_HIT).alias("hits"))
    return F.when(F.size(found) > 0, F.aggregate(sizes, begin, follow, lambda state: state["hits"])).otherwise(F.array().cast(_HIT))


def kept_hits(hits: Column) -> Column:
    """Hits in order, without those inside an earlier one of equal or better priority."""
    ordered = F.transform(
        F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), (-h["stop"]).alias("back"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label")))),
        lambda h: F.struct(h["start"].alias("start"), (-h["back"]).alias("stop"), h["priority"].alias("priority"), h["rule"].alias("rule"), h["label"].alias("label")),
    )

    def follow(state: Column, h: Column) -> Column:
        reach = [state["p1"], F.greatest(state["p1"], state["p2"]), F.greatest(state["p1"], state["p2"], state["p3"])]
        inside = h["stop"] <= F.element_at(F.array(*reach), h["priority"])
        ends = [F.when(h["priority"] == p, F.greatest(state[f"p{p}"], h["stop"])).otherwise(state[f"p{p}"]).alias(f"p{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], h)).alias("kept"))

    start = F.struct(*[F.lit(-1).alias(f"p{p}") for p in (1, 2, 3)], F.array().cast(_HIT).alias("kept"))
    return F.aggregate(ordered, start, follow, lambda state: state["kept"])


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the ``hits``.

    ``score`` is 1 for a hit of priority 1, 0.8 and 0.5 for the others at best, 0.8 for a base phrase, else 0.
    """
    signatures = rules() if signatures is None else signatures
    listed = F.array(
        *[
            F.struct(F.lit(r.keyword).alias("keyword"), F.lit(r.regex).alias("regex"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rule"))
            for i, r in enumerate(signatures)
        ]
    )
    base = texts(docs).select("doc_id", "text", spaced_words(F.col("text")).alias("spaced"))
    # one look at the words and one at the text decide whether there is anything to search
    worth = F.col("spaced").contains("license") | F.col("spaced").contains(" cc by ")
    keywords = sorted({r.keyword for r in signatures})
    gate = None
    low = lowered(F.col("text"))
    for keyword in keywords:
        gate = F.col("low").contains(keyword) if gate is None else gate | F.col("low").contains(keyword)
    rows = base.select("*", worth.alias("worth"), low.alias("low"))
    no_hits = F.array().cast(_HIT)
    places = F.array(*[F.struct(F.lit(label).alias("label"), phrase_places(F.col("spaced"), phrase).alias("at")) for phrase, label in BASE.items()])
    found = F.filter(places, lambda b: b["at"]["times"] > 0)
    rows = rows.withColumn("base", F.when(F.col("worth"), found).otherwise(F.array().cast(_BASE)))
    due = F.filter(listed, lambda r: F.col("low").contains(r["keyword"]))
    raw = F.flatten(F.transform(due, lambda r: _spans(F.col("low"), r)))
    gated = gate if gate is not None else F.lit(False)
    rows = rows.withColumn("raw", F.when(gated, raw).otherwise(no_hits))
    rows = rows.withColumn("hits", F.when(F.size("raw") > 0, kept_hits(F.col("raw"))).otherwise(no_hits))
    rows = rows.withColumn("own", F.array_sort(F.transform("base", lambda b: b["label"])))
    rows = rows.withColumn("at", F.transform("base", lambda b: b["at"]))
    total = F.aggregate("at", F.lit(0).cast("bigint"), lambda n, a: n + a["times"])
    labels = F.array_sort(F.array_distinct(F.concat("own", F.transform("hits", lambda h: h["label"]))))
    best = F.array_min(F.transform("hits", lambda h: h["priority"]))
    strength = F.when(best == 1, 1.0).when((best == 2) | (F.size("own") > 0), 0.8).when(best == 3, 0.5).otherwise(0.0)
    return rows.select(
        "doc_id",
        (_blanks(F.col("spaced")) - 1).cast("bigint").alias("n_words"),
        total.alias("n_base"),
        F.array_min(F.transform("at", lambda a: a["first"])).alias("first_word"),
        F.array_max(F.transform("at", lambda a: a["last"])).alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        strength.alias("score"),
        "hits",
    )
