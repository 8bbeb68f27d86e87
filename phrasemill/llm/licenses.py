"""Licence scans by recognised sentences and ordered rules, with DataFrame functions only.

A text is cut into sentences, each sentence is normalised, and the known phrases in it give it a
list of identifiers. The identifiers of a document, in order, are one sequence. Licence rules are
tried in their order on that sequence: a rule whose identifiers stand next to each other in it names
a licence and takes them out, so that a general rule does not report again what a special one has
explained. Everything happens within the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence without any of these words is never about a licence.
CANDIDATE = (
    r"(?i)licen[cs]|copyright|warrant|redistribut|permission|public domain|creative commons|cc.by|cc0|rights reserved|neither the name|gnu a?l?gpl"
)
#: Sentences end at a stop before white space, at an empty line, or at the end of the text.
SENTENCE_END = r"[.!?;:]+\s+|\n\s*\n"
# Known phrases of normalised sentences and their identifiers, in the order in which
# the identifiers of one sentence are listed.
PHRASES = [
    ("AGPL", r"\b(gnu affero general public licen[cs]e|gnu agpl)\b"),
    ("LGPL", r"\b(gnu (lesser|library) general public licen[cs]e|gnu lgpl)\b"),
    ("GPL", r"\b(gnu general public licen[cs]e|gnu gpl)\b"),
    ("APACHE", r"\bapache (software )?licen[cs]e\b"),
    ("MPL", r"\bmozilla public licen[cs]e\b"),
    ("EPL", r"\beclipse public licen[cs]e\b"),
    ("BSL", r"\bboost software licen[cs]e\b"),
    ("MIT", r"\b(mit|expat) licen[cs]e\b"),
    ("ISC", r"\bisc licen[cs]e\b"),
    ("ZLIB", r"\bzlib licen[cs]e\b"),
    ("BSD", r"\bbsd( style| [234] clause)? licen[cs]e\b"),
    ("UNLICENSE", r"\bthis is free and unencumbered software released into the public domain\b"),
    ("CC0", r"\b(cc0|creative commons zero)\b"),
    ("CC-BY-NC-SA", r"\b(cc by nc sa|attribution noncommercial sharealike)\b"),
    ("CC-BY-NC-ND", r"\b(cc by nc nd|attribution noncommercial noderiv(ative)?s)\b"),
    ("CC-BY-NC", r"\b(cc by nc|attribution noncommercial)( [0-9]|$| international| licen[cs]e)"),
    ("CC-BY-SA", r"\b(cc by sa|attribution sharealike)\b"),
    ("CC-BY-ND", r"\b(cc by nd|attribution noderiv(ative)?s)\b"),
    ("CC-BY", r"\b(cc by|creative commons attribution)( [0-9]|$| international| licen[cs]e)"),
    ("V1", r"\b(version |v)1(\.0)?\b"),
    ("V1.1", r"\b(version |v)1\.1\b"),
    ("V2", r"\b(version |v)2(\.0)?($| |,)"),
    ("V2.1", r"\b(version |v)2\.1\b"),
    ("V3", r"\b(version |v)3(\.0)?\b"),
    ("LATER", r"\bany later version\b"),
    ("MIT-GRANT", r"\bpermission is hereby granted free of charge to any person obtaining a copy\b"),
    ("MIT-NOTICE", r"\babove copyright notice and this permission notice shall be included\b"),
    ("ISC-GRANT", r"\bpermission to use copy modify and( or)? distribute this software for any purpose\b"),
    ("BSD-SOURCE", r"\bredistributions of source code must retain the above copyright\b"),
    ("BSD-BINARY", r"\bredistributions in binary form must reproduce the above copyright\b"),
    ("BSD-NAME", r"\bneither the name\b.*\bendorse or promote\b"),
    ("AS-IS", r"\bprovided (by .* )?as is\b"),
    ("PUBLIC-DOMAIN", r"\b(in|into) the public domain\b"),
    ("RESERVED", r"\ball rights reserved\b"),
    ("COPYRIGHT", r"\bcopyright (c |by )?([0-9]{4}|[a-z]+ [0-9]{4})\b"),
]
# Licences and the identifiers that stand for them, special ones first.
RULES = [
    ("BSD-3-Clause", ["BSD-SOURCE", "BSD-BINARY", "BSD-NAME"]),
    ("BSD-2-Clause", ["BSD-SOURCE", "BSD-BINARY"]),
    ("MIT", ["MIT", "COPYRIGHT", "MIT-GRANT", "MIT-NOTICE", "AS-IS"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE", "AS-IS"]),
    ("MIT", ["MIT-GRANT", "MIT-NOTICE"]),
    ("ISC", ["ISC-GRANT", "AS-IS"]),
    ("ISC", ["ISC-GRANT"]),
    ("Unlicense", ["UNLICENSE", "PUBLIC-DOMAIN"]),
    ("AGPL-3.0-or-later", ["AGPL", "V3", "LATER"]),
    ("AGPL-3.0-only", ["AGPL", "V3"]),
    ("LGPL-3.0-or-later", ["LGPL", "V3", "LATER"]),
    ("LGPL-2.1-or-later", ["LGPL", "V2.1", "LATER"]),
    ("LGPL-3.0-only", ["LGPL", "V3"]),
    ("LGPL-2.1-only", ["LGPL", "V2.1"]),
    ("GPL-3.0-or-later", ["GPL", "V3", "LATER"]),
    ("GPL-2.0-or-later", ["GPL", "V2", "LATER"]),
    ("GPL-3.0-only", ["GPL", "V3"]),
    ("GPL-2.0-only", ["GPL", "V2"]),
    ("Apache-2.0", ["APACHE", "V2"]),
    ("Apache-1.1", ["APACHE", "V1.1"]),
    ("MPL-2.0", ["MPL", "V2"]),
    ("MPL-1.1", ["MPL", "V1.1"]),
    ("EPL-2.0", ["EPL", "V2"]),
    ("EPL-1.0", ["EPL", "V1"]),
    ("BSL-1.0", ["BSL", "V1"]),
    *[(name, [name]) for name in ("AGPL", "LGPL", "GPL", "APACHE", "MPL", "EPL", "BSL", "MIT", "ISC", "ZLIB", "BSD", "CC0",
                                  "CC-BY-NC-SA", "CC-BY-NC-ND", "CC-BY-NC", "CC-BY-SA", "CC-BY-ND", "CC-BY", "PUBLIC-DOMAIN")],
    ("all-rights-reserved", ["RESERVED"]),
]
#: A sentence that speaks of a licence in words that no phrase knows.
UNKNOWN = "UNKNOWN"
LICENCE_WORD = r"\blicen[cs]ed? "


def normalised(sentence: Column) -> Column:
    """Lower case; letters, digits and dots inside a word stay, everything else is one space."""
    plain = F.regexp_replace(F.lower(sentence), "[^a-z0-9.]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\.+( |$)", " "), " +", " "))


def identifiers(sentence: Column) -> Column:
    """The identifiers of a normalised sentence: those of its phrases, or UNKNOWN, or none."""
    known = F.array_compact(F.array(*[F.when(sentence.rlike(pattern), F.lit(name)) for name, pattern in PHRASES]))
    unknown = F.when(F.concat(sentence, F.lit(" ")).rlike(LICENCE_WORD), F.array(F.lit(UNKNOWN)))
    return F.when(F.size(known) > 0, known).otherwise(F.coalesce(unknown, F.array().cast("array<string>")))


def recognise(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``sentences``, ``sequence``, ``licences`` and ``n_unknown`` to every row.

    ``sentences`` lists each recognised sentence with its identifiers, ``sequence`` joins all
    identifiers by ``;``, ``licences`` joins the names of the matching rules in rule order, each
    once, by ``,``. Null, empty and plain texts give empty results. Columns of the input with
    these names are replaced.
    """
    cut = F.filter(F.split(F.col(text), SENTENCE_END), lambda s: s.rlike(CANDIDATE))
    known = F.filter(
        F.transform(cut, lambda s: F.struct(s.alias("sentence"), identifiers(normalised(s)).alias("ids"))),
        lambda x: F.size(x["ids"]) > 0,
    )
    nothing = F.array().cast("array<struct<sentence:string,ids:array<string>>>")
    found = F.when(F.col(text).rlike(CANDIDATE), known).otherwise(nothing)
    sequence = F.array_join(F.flatten(F.col("sentences.ids")), ";")
    # two separators between identifiers, so that neighbours can be taken out one by one
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f";{';;'.join(ids)};").alias("ids")) for name, ids in RULES])
    start = F.struct(F.concat(F.lit(";"), F.replace(F.col("sequence"), F.lit(";"), F.lit(";;")), F.lit(";")).alias("rest"),
                     F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        fresh = hit & ~F.array_contains(state["names"], rule["name"])
        return F.struct(
            F.replace(state["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(fresh, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    licences = F.aggregate(rules, start, apply, lambda state: F.array_join(state["names"], ","))
    added = ("sentences", "sequence", "licences", "n_unknown")
    kept = [f"`{c}`" for c in df.columns if c not in added]
    return (
        df.withColumn("sentences", F.coalesce(found, nothing)).withColumn("sequence", sequence)
        .withColumn("licences", F.when(F.col("sequence") == "", F.lit("")).otherwise(licences))
        .withColumn("n_unknown", F.size(F.filter(F.flatten("sentences.ids"), lambda x: x == UNKNOWN)).cast("bigint"))
        .select(*kept, *added)
    )
