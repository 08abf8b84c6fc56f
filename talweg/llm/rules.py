"""Operator 1, quality rules: line-first cleaning, in built-in functions only.

Every line of a text is judged by itself (punctuation, navigation, boilerplate); failing lines go, and a
document that loses too much of its text goes with them. All work on a document happens in its own row, so
the plan is a scan and a projection: no exchange, whatever the key distribution.

Defined results: a null text counts as empty; an empty text has no words, fails the base rules and is not
kept; repeated rows are judged alike, each by itself; further columns of the input are passed through by
`clean` unless their names clash with its results, which then replace them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, words_of, unused

SYMBOLS = "[#*$%&|<>]"
#: A line of text ends in one of these, closing marks left aside: Latin and Greek, wide forms, Arabic, Indic, Armenian, Ethiopic.
TERMINAL = ".!?…:;‽" + "。！？：；" + "؟۔؛" + "।॥" + "։" + "።"
CLOSING = "\"'”’»)]}“‘" + "」』）】》〉"
#: Words of menus, in lower case, in English, French, German and Spanish; a line of nothing else is navigation.
NAVIGATION_WORDS = [
    "home", "menu", "log ?in", "log ?out", "sign ?(?:in|up)", "register", "next", "previous", "back", "back to top", "contact", "contact us", "about", "about us", "search", "share", "sitemap", "read more", "skip to content", "subscribe",
    "accueil", "connexion", "se connecter", "s['’]inscrire", "suivant", "précédent", "retour", "haut de page", "contactez-nous", "à propos", "rechercher", "recherche", "partager", "plan du site", "lire la suite",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "nach oben", "kontakt", "über uns", "suche", "teilen", "impressum", "mehr lesen", "weiterlesen",
    "inicio", "menú", "iniciar sesión", "registrarse", "siguiente", "anterior", "volver", "volver arriba", "contacto", "acerca de", "sobre nosotros", "buscar", "compartir", "mapa del sitio", "leer más",
]
NAVIGATION = r"^[\x00-\x2f:-@\[-`{-~»›·•]*(?:" + "|".join(NAVIGATION_WORDS) + r")(?:[\x00-\x2f:-@\[-`{-~»›·•]+(?:" + "|".join(NAVIGATION_WORDS) + r"))*[\x00-\x2f:-@\[-`{-~»›·•]*$"
#: A bar between words, as in menus and bread crumbs.
BARS = r"[|»>]\s"
#: Phrases of notices, in lower case, in the same languages.
BOILERPLATE = [
    "licensed under", "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "uses cookies", "enable javascript", "lorem ipsum", "subscribe to our", "click here",
    "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "utilise des cookies", "cliquez ici", "abonnez-vous",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "klicken sie hier", "newsletter abonnieren",
    "todos los derechos reservados", "términos de uso", "términos y condiciones", "política de privacidad", "utiliza cookies", "haga clic aquí", "suscríbete",
]
#: Up to so many distinct repeated windows are looked up one by one; beyond that, positions are sorted.
FEW = 8


def window_hashes(words: Column) -> Column:
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def repeat_words(h: Column) -> Column:
    """Words inside a window of three that occurs at least twice, from the windows' hashes in order.

    Sorted, equal hashes stand side by side, which names the repeated ones in n log n steps.
    """

    def covered(positions: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda i: F.array(i, i + 1, i + 2)))))

    def by_lookup(d: Column) -> Column:
        return covered(F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i))))

    def by_sort(placed: Column) -> Column:
        same = F.filter(placed, lambda x, j: F.coalesce(F.get(placed, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(placed, j + 1)["h"] == x["h"], F.lit(False)))
        return covered(F.transform(same, lambda x: x["i"]))

    def choose(d: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= FEW, by_lookup(d)).otherwise(let(placed, by_sort))

    return let(F.sort_array(h), lambda s: let(F.array_distinct(F.filter(s, lambda x, j: F.get(s, j - 1) == x)), choose))


def word_counts(text: Column) -> Column:
    """n_words, word_chars and n_repeat_words, the text being split once."""
    counted = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), let(window_hashes(w), repeat_words).cast("long").alias("n_repeat_words"))
    return let(words_of(text), counted)


def line_counts(text: Column) -> Column:
    """The lines with their symbols, whether they hold a word and whether they pass the line rules."""
    judged = F.transform(F.split(text, "\n"), lambda x: let(F.regexp_count(x, F.lit(SYMBOLS)), lambda k: F.struct(x.alias("line"), k.alias("symbols"), line_passes(x, k).alias("passes"))))

    def counted(lines: Column) -> Column:
        solid = F.filter(F.transform(lines, lambda x: x["line"]), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        clean = F.array_join(F.transform(F.filter(lines, lambda x: x["passes"]), lambda x: x["line"]), "\n")
        return F.struct(F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + x["symbols"]).alias("n_symbols"), let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), clean.alias("clean_text"))

    return let(judged, counted)


def line_passes(line: Column, symbols: Column, max_symbols: float = 0.05) -> Column:
    """False for a line that a rule removes. Blank lines pass: they carry no words to lose."""
    chars = F.length(line)
    end = F.right(F.rtrim(line, F.lit(CLOSING + SPACES)), F.lit(1))
    shouted = (chars > 20) & line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    punctuation = end.isin(*TERMINAL) & (symbols <= max_symbols * chars) & ~shouted
    bars = (symbols > 0) & (F.regexp_count(line, F.lit(BARS)) >= 3)
    worded = let(F.lower(line), lambda low: ((chars < 120) & low.rlike(NAVIGATION)) | any_of(low.contains(x) for x in BOILERPLATE))
    return (end == "") | (punctuation & ~bars & ~worded)


def any_of(tests) -> Column:
    tests = list(tests)
    return functools.reduce(lambda a, b: a | b, tests)


def clean(docs: DataFrame, text: str = "text", min_words: int = 50, max_repeat_percent: int = 50, min_left: float = 0.5) -> DataFrame:
    """`docs` with the counts, `base_failed`, `clean_text` (lines that pass), `left_chars` (its length) and `kept`."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, lines = unused(docs, "_w", "_l")
    own = F.struct(word_counts(t).alias(words), line_counts(t).alias(lines))
    out = docs.select("*", F.inline(F.array(own)))  # the generator keeps the optimizer from computing the lambdas once per use
    w, x = F.col(words), F.col(lines)
    failed = (w["n_words"] < min_words) | (100 * w["n_repeat_words"] > max_repeat_percent * w["n_words"])
    left = F.length(x["clean_text"]).cast("long")
    new = {
        "n_words": w["n_words"], "word_chars": w["word_chars"], "n_symbols": x["n_symbols"], "n_dup_lines": x["n_dup_lines"], "n_repeat_words": w["n_repeat_words"],
        "base_failed": failed, "clean_text": x["clean_text"], "left_chars": left, "kept": ~failed & (left >= min_left * F.length(t)),
    }
    return out.select(*[c for c in docs.columns if c not in new], *[c.alias(k) for k, c in new.items()])


def query(docs: DataFrame) -> DataFrame:
    """The contract's columns, for every document."""
    return clean(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The same in DuckDB SQL: windows as rows that are counted, lines as lists that are filtered.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, string_split(t, chr(10)) AS lines FROM d),
placed AS (SELECT n, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
triples AS (SELECT n, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY n ORDER BY i)),
again AS (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM triples WHERE c IS NOT NULL),
repeated AS (SELECT n, count(DISTINCT i + j) AS n_repeat_words FROM again, range(3) r(j) WHERE k > 1 GROUP BY n),
judged AS (SELECT n, list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS solid, array_to_string(list_filter(lines, lambda x: rtrim(x, {quoted(CLOSING)} || ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = ''
    OR (contains({quoted(TERMINAL)}, right(rtrim(x, {quoted(CLOSING)} || ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) AND len(regexp_extract_all(x, '{SYMBOLS}')) <= 0.05e0 * length(x)
        AND NOT (length(x) > 20 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')) AND NOT (len(regexp_extract_all(x, '{SYMBOLS}')) > 0 AND len(regexp_extract_all(x, '{BARS}')) >= 3)
        AND NOT (length(x) < 120 AND regexp_matches(lower(x), {quoted(NAVIGATION)})) AND NOT ({" OR ".join(f"contains(lower(x), {quoted(p)})" for p in BOILERPLATE)}))), chr(10)) AS clean FROM w),
counted AS (SELECT w.doc_id, t, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(len(solid) - len(list_distinct(solid)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(length(clean) AS BIGINT) AS left_chars FROM w JOIN judged USING (n) LEFT JOIN repeated USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars >= 0.5e0 * length(t) AS kept, left_chars FROM counted
"""
