"""Quality rules, line first (operator 6), as DataFrame expressions only.

Each line of a text is judged by itself: lines in which no sentence ends,
lines of symbols or shouting, navigation lines and boilerplate lines fail and
are removed; blank lines are neutral. A document is then rejected if it fails
the base rules or if removing lines cost too much of its text.

The repeated-window count hashes each five-word window to 64 bits; texts with
repeated hashes sort (hash, position) pairs and add up what the windows cover,
in n log n for any text. Everything is computed within the row: no shuffle.

Defined cases: null, empty and blank texts have no words, fail the base rules
and are not kept; equal lines count from the second on; columns besides those
named are kept by ``quality_filter``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let
from .mixing import SPACES, WORD_GAP

WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

# FIXED VALUES of the line rules
CLOSING = "[.!?:;…。！？\"'”’»)\\]][\\x20\\x09-\\x0D]*$"
SENTENCE = "[.!?。！？…][\"'”’»)\\]]?[\\x20\\x09]|" + CLOSING  # a sentence ends in the line, or the line is closed
NAVIGATION_LINES = (
    "home|menu|log ?in|log ?out|sign (?:in|up)|search|share|next|previous|back to top|read more|click here|"
    "skip to (?:main )?content|contact(?: us)?|about(?: us)?|site ?map",                                                      # English
    "startseite|menü|anmelden|abmelden|registrieren|suche|suchen|teilen|weiter|zurück|nach oben|mehr lesen|weiterlesen|hier klicken|"
    "zum inhalt springen|kontakt|über uns|impressum|inhaltsverzeichnis",                                                      # German
    "accueil|connexion|déconnexion|se connecter|s'inscrire|rechercher|recherche|partager|suivant|précédent|haut de page|lire la suite|"
    "cliquez ici|aller au contenu|contactez-nous|à propos|plan du site",                                                      # French
    "inicio|menú|iniciar sesión|cerrar sesión|registrarse|buscar|compartir|siguiente|anterior|volver arriba|leer más|haga clic aquí|"
    "ir al contenido|contacto|contáctenos|sobre nosotros|quiénes somos|mapa del sitio")                                       # Spanish
NAVIGATION = f"(?iu)^[\\x20\\x09-\\x0D]*(?:{'|'.join(NAVIGATION_LINES)})[\\x20\\x09-\\x0D.!>»|]*$"
SEPARATORS = "(?:[|»›•·][^|»›•·]*){2,}"
BOILERPLATE_PHRASES = (
    "all rights reserved|licensed under|released under the|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|"
    "accept (?:all )?cookies|enable javascript|powered by|copyright ©|lorem ipsum|subscribe to our",                           # English
    "alle rechte vorbehalten|lizenziert unter|veröffentlicht unter der|nutzungsbedingungen|datenschutzerklärung|cookie-richtlinie|"
    "wir verwenden cookies|(?:alle )?cookies akzeptieren|aktivieren sie javascript|abonnieren sie unseren",                     # German
    "tous droits réservés|sous licence|conditions d['’]utilisation|politique de confidentialité|politique en matière de cookies|"
    "nous utilisons des cookies|accepter (?:tous )?les cookies|activez javascript|abonnez-vous à notre",                        # French
    "todos los derechos reservados|bajo (?:la )?licencia|términos de (?:uso|servicio)|condiciones de uso|política de privacidad|"
    "política de cookies|utilizamos cookies|aceptar (?:todas las )?cookies|active javascript|suscríbase a nuestr[oa]")              # Spanish
BOILERPLATE = f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(BOILERPLATE_PHRASES)})(?![\\p{{L}}\\p{{N}}])"
MOST_LOST = 0.6       # of a document's word characters
MOST_SYMBOLS = 0.25   # symbols to words, in a line
MOST_SHOUTS = 0.3     # words ending in two or more marks, in a line


def words(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP)))


def repeated_words(w: Column) -> Column:
    """Words of an array that lie in five-word windows found twice or more in it."""
    def covered(h):
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        at = let(tagged, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"])), lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x))
    windows = F.transform(F.slice(w, F.lit(1), F.size(w) - (WINDOW - 1)),
                          lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, WINDOW))))
    return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(
        let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def good_line(line: Column) -> Column:
    """Whether a line passes the punctuation, symbol, navigation and boilerplate rules."""
    n_words = F.size(F.split(F.btrim(line, F.lit(SPACES)), WORD_GAP))
    symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
    shouts = F.when(F.contains(line, F.lit("!!")) | F.contains(line, F.lit("??")), F.size(F.filter(
        F.split(line, WORD_GAP), lambda w: w.rlike("[!?]{2}$")))).otherwise(F.lit(0))
    return (~line.rlike(WORD) |
            (line.rlike(SENTENCE) & ~((F.length(line) <= 40) & line.rlike(NAVIGATION))
             & ~line.rlike(SEPARATORS) & ~((F.length(line) <= 300) & F.lower(line).rlike(BOILERPLATE))
             & (symbols <= MOST_SYMBOLS * n_words) & (shouts <= MOST_SHOUTS * n_words)))


def _chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), ""))


def measures(text: Column) -> Column:
    """One struct a text: the base counts, the cleaned text and both verdicts."""
    def of(t):
        def lines_of(lines):
            full = F.filter(lines, lambda x: x.rlike(WORD))
            cleaned = F.array_join(F.filter(lines, good_line), "\n")
            return F.struct((F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"), cleaned.alias("cleaned"))

        def counted(w):
            return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                            repeated_words(w).cast("long").alias("n_repeat_words"))
        n_symbols = (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long")
        return let(counted_words(t, counted), lambda c: let(let(F.split(t, "\n"), lines_of), lambda d: F.struct(
            c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), n_symbols.alias("n_symbols"),
            d["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"), d["cleaned"].alias("cleaned"),
            ((c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])).alias("base_failed"),
            F.when(d["cleaned"] == t, c["word_chars"]).otherwise(_chars(d["cleaned"])).alias("kept_chars"))))

    def counted_words(t, counted):
        return let(words(t), counted)
    return let(F.coalesce(text, F.lit("")), of)


def kept(m: Column) -> Column:
    return ~m["base_failed"] & (m["kept_chars"] >= (1 - MOST_LOST) * m["word_chars"])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept per document."""
    m = F.col("m")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (docs.select(F.col(f"`{id_col}`").alias("doc_id"), measures(F.col(f"`{text_col}`")).alias("m"))
            .select("doc_id", *(m[n].alias(n) for n in names), kept(m).alias("kept")))


def quality_filter(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents that pass, with the failing lines removed from their text
    (and their length, if they have that column, counted anew)."""
    columns = docs.columns
    # a generator, so that the measures are not computed once for the filter and again for the text
    judgement = fresh(docs, "__measures")
    judged = docs.withColumn(judgement, F.explode(F.filter(F.array(measures(F.col(f"`{text_col}`"))), kept)))
    cleaned = F.col(f"{judgement}.cleaned")
    new = {text_col: cleaned} | ({length_col: F.length(cleaned).cast(docs.schema[length_col].dataType)} if length_col in columns else {})
    return judged.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in columns))
