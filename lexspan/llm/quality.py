"""Quality rules, line first.

Each line that has a word is judged by three rules. Punctuation: `least_punct` of its visible characters or more, and over
`max_punct` per cent of them, are punctuation or symbols. Navigation: `min_bars` or more separators stand alone and are `bar_share` per cent of its
words or more; or it has at most `nav_words` words, of which navigation terms ("log in", "next") are `nav_share` per cent or more. Boilerplate: phrases such
as "all rights reserved" are `boiler_share` per cent of its words or more. So a rule removes a line for what it mostly is, whatever its
length, and prose that mentions a term stays. Terms are whole words, compared in ASCII lower case without outer ASCII punctuation. Failing lines are
removed; a document is rejected if it fails the base rules or if the removed lines held more than `max_lost` per cent of its word characters.

Words are `[^\\x20\\x09-\\x0D]+`. Cases: a null text is the empty one, which has no words, fails the base rules and is not
kept; a null doc_id is kept as null; repeated rows are judged each; an empty table gives no rows; other columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lexspan.llm.common import arrow, as_batch, id_text, over_columns, rows_of

# The symbols, separators and phrases of the rules.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BARS = ("|", "»", "›", ">", "/", "·", "•")
NAVIGATION = (
    *("home", "menu", "login", "log in", "logout", "log out", "sign in", "sign up", "register", "next", "previous", "share", "search", "sitemap", "subscribe", "contact us", "about us", "skip to content", "back to top", "read more"),
    *("accueil", "connexion", "déconnexion", "s'inscrire", "suivant", "précédent", "partager", "rechercher", "plan du site", "contactez-nous", "à propos", "À propos", "lire la suite", "haut de page"),
    *("startseite", "anmelden", "abmelden", "registrieren", "weiter", "zurück", "teilen", "suche", "kontakt", "über uns", "Über uns", "nach oben", "weiterlesen"),
    *("inicio", "iniciar sesión", "cerrar sesión", "registrarse", "siguiente", "anterior", "compartir", "buscar", "mapa del sitio", "contáctenos", "sobre nosotros", "leer más", "volver arriba"),
)
BOILERPLATE = (
    *("all rights reserved", "copyright ©", "privacy policy", "terms of use", "terms of service", "cookie policy", "we use cookies", "enable javascript", "lorem ipsum", "unsubscribe"),
    *("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "nous utilisons des cookies", "se désabonner"),
    *("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "impressum", "wir verwenden cookies"),
    *("todos los derechos reservados", "política de privacidad", "términos de uso", "condiciones de uso", "usamos cookies", "aviso legal", "darse de baja"),
)
_SPACES = " \t\n\x0b\x0c\r"

FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_bad_lines long, lost_chars long"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass(frozen=True)
class LineRules:
    max_punct: int = 25
    least_punct: int = 6
    min_bars: int = 3
    bar_share: int = 15
    nav_words: int = 6
    nav_share: int = 50
    boiler_share: int = 30
    max_lost: int = 50


def _ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()


_PUNCT_OUT = str.maketrans("", "", PUNCTUATION)


def spaced(term: str) -> str:
    """A term or line with a blank before and after each word, so that whole words are found and neighbours share no blank."""
    return "".join(f" {x} " for x in term.split(" "))


def _words_in(terms: tuple[str, ...], line: str) -> int:
    """How many words of the line, spaced, belong to the terms; no two terms of a list overlap in a line."""
    return sum(line.count(spaced(t)) * len(t.split(" ")) for t in terms)


def line_fails(line: str, rules: LineRules = LineRules()) -> bool:
    """For a line that has a word."""
    if not (words := line.encode().split()):
        return False
    n = len(words)
    if any(x in line for x in BARS):
        bars = sum(1 for x in words if x.decode() in BARS)
        if bars >= rules.min_bars and 100 * bars >= rules.bar_share * n:
            return True
    low = _ascii_lower(line)
    nav, boiler = n <= rules.nav_words and any(t in low for t in NAVIGATION), any(t in low for t in BOILERPLATE)
    if nav or boiler:
        bare = "".join(f" {x.strip(PUNCTUATION)} " for x in b" ".join(words).lower().decode().split(" "))
        if nav and 100 * _words_in(NAVIGATION, bare) >= rules.nav_share * n or boiler and 100 * _words_in(BOILERPLATE, bare) >= rules.boiler_share * n:
            return True
    dense = b"".join(words).decode()
    punct = len(dense) - len(dense.translate(_PUNCT_OUT))
    return punct >= rules.least_punct and 100 * punct > rules.max_punct * len(dense)


def repeat_words(words: list) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {x for x, n in Counter(windows).items() if n > 1}
    total, end = 0, 0
    for i, x in enumerate(windows):
        if x in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judge(text: str, rules: LineRules = LineRules()) -> tuple[tuple, str]:
    """(n_words … lost_chars as in FIELDS, without doc_id), and the text without its failing lines."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    repeats = repeat_words(words)
    lines = text.split("\n")
    with_words = [x for x in lines if x.strip(_SPACES)]
    duplicates = len(with_words) - len(set(with_words))
    bad = {x: line_fails(x, rules) for x in set(with_words)}
    n_bad = lost = 0
    left = text
    if any(bad.values()):
        n_bad = sum(bad[x] for x in with_words)
        lost = sum(len(x) - sum(map(x.count, _SPACES)) for x in with_words if bad[x])
        left = "\n".join(x for x in lines if not bad.get(x, False))
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and 100 * lost <= rules.max_lost * chars
    return (n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, kept, n_bad, lost), left


def quality(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """One row a document, as FIELDS says; with_text adds `cleaned`, the text without failing lines."""
    fields = FIELDS + ", cleaned string" * with_text
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in fields.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in rows_of(batches):
            rows = [(key, *found, left) if with_text else (key, *found) for key, (found, left) in zip(keys, (judge(x, rules) for x in texts), strict=True)]
            yield as_batch(schema, *zip(*rows, strict=True))

    return arrow(id_text(docs), task, fields)


def keep_good(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that are kept, their failing lines removed; the other columns stay, n_chars (if there) is counted anew."""
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * (1 << 21) / max(1, whole.nbytes)))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                judged = [judge(x or "", rules) for x in batch.column(at).to_pylist()]
                pick = pa.array([i for i, (x, _) in enumerate(judged) if x[6]], type=pa.int32())
                texts = [left for x, left in judged if x[6]]
                columns = [c.take(pick) for c in batch.columns]
                columns[at] = pa.array(texts, type=batch.schema.field(at).type)
                if count is not None:
                    columns[count] = pa.array(map(len, texts), type=batch.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return over_columns(docs, task)
