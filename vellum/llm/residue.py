"""Template residue, filler and error pages (problem 8).

Two questions per text, both answered by regular expressions inside the JVM, without a shuffle.

Open fields: one grammar per delimiter, over the text without code blocks and without fields that stand in quotation
marks (a text that explains a notation quotes it). Square and angle brackets and guillemets serve other ends in
legal texts, so there the content must look like a field: a word of instruction, a name with underscores, a bullet or a
blank. Blanks count unless they end a line after a colon, or fill a line, as those for signatures do.

Whole texts of filler or messages: the text is cut into lines and sentences; each is residue if it says of a page, server, login
or the like that it failed, asks for scripts, tells the reader to try again, or begins in a form of such messages or of filler, and
does not speak of parties or clauses. The text is residue if such pieces hold at least DENSITY of its letters and digits, so a contract
that quotes a message is none. Filler without phrases is found by its words: few different ones, or all of them
from a filler vocabulary, or all typed on one row of keys.

Defined results: null, empty, blank and invisible texts are no cases; repeated rows give repeated rows; very long texts are
searched in whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.tokenize import let

DENSITY = 0.75

#: A field goes on to its closing delimiter, however long it is.
_NAME = r"[\p{L}][\p{L}\p{N}_ \-.:/\n]*+"
#: Words that ask for something to be put in, in five languages. Fixed values.
_ASK = r"insert|fill in|enter|add here|complete|hier einsetzen|einsetzen|einfügen|eintragen|ausfüllen|insérer|inserer|à compléter|a completer|compléter|indiquer|insertar|por completar|completar|rellenar|indicar|inserire|da inserire|da completare|compilare|indicare|to be (?:inserted|completed|determined|agreed|confirmed|advised)|tbd|tbc|tba|placeholder|xxx+"
#: What fields are called when no underscore tells. Fixed values.
_FIELDS = r"(?:your |the )?(?:party|client|customer|supplier|company|tenant|landlord|start|end|effective|notice|fee|governing|signing|contract)?[ _]?(?:name|title|amount|date|address|signatory|territory|jurisdiction|law|percentage|party|client|currency|term)(?: of (?:the )?(?:supplier|client|party|company|services))?|description of services|name des lieferanten|vertragspartner|betrag|datum|laufzeit(?: monate)?|ort|raison sociale|nom du bailleur|montant|durée|lieu|raz[oó]n social|nombre del \p{L}+|importe|plazo|lugar|fecha|ragione sociale|nome del fornitore|importo|luogo|data|durata"
_IDENT = r"[\p{L}\p{N}]+(?:_[\p{L}\p{N}]+)+"
_LETTER = r"[\p{L}\p{N}]"


def _after(what: str, opening: str) -> str:
    """opening where none of what stands before it. The literal comes first, so that the search skips to it."""
    return rf"{opening}(?<!{what}{opening})"


def _unquoted(opening: str, more: str = "") -> str:
    return _after(r"[“„\"'‘‚«`" + more + "]", opening)


#: One grammar per delimiter.
FIELD_GRAMMARS = {
    "double_brace": _unquoted(r"\{\{") + r"\{?\s*[#/&^>]?\s*" + _NAME + r"\s*\}\}",
    "template_tag": r"\{%-?\s*" + _NAME + r"\s*-?%\}|<%[=\-#]?\s*" + _NAME + r"\s*-?%>",
    "dollar": r"\$\{\s*" + _NAME + r"\s*\}|\$\(" + _IDENT + r"\)",
    "single_brace": _unquoted(r"\{", r"{$%\\") + r"\s*(?:\p{L}[\p{L}\p{N}_ \-\n]++|\d+\s*)\}(?!\})",
    "double_square": _unquoted(r"\[\[") + r"\s*" + _NAME + r"\s*\]\]",
    "square": "(?i)" + _unquoted(r"\[", r"\[") + r"\s*(?:(?:" + _ASK + r")\b[^\[\]]*+|" + _IDENT + r"|(?:" + _FIELDS + r")|[•●_▪■ \t]*[•●_▪■][•●_▪■ \t]*|[^\[\]]*\b(?:" + _ASK + r"))\s*\](?!\])",
    "angle": _unquoted("<<") + r"\s*" + _NAME + r"\s*>>|(?i)<\s*(?:(?:" + _ASK + r")\b[^<>]*+|" + _IDENT + r"|(?:" + _FIELDS + r")|[^<>@/]*\b(?:" + _ASK + r"))\s*>",
    "capital_angle": _unquoted("<") + r"\s*\p{Lu}{2}[\p{Lu} _\n]++>",
    "guillemet": r"«(?:" + _IDENT + r"|[\p{Lu}_]{3,}+|\p{L}{3,}+|(?i:" + _ASK + r")[^«»]*+|(?i:" + _FIELDS + r"))»",
    "percent": _after(r"[\p{L}\p{N}%]", "%") + rf"(?:[\p{{L}}_]{{3,}}+%(?!{_LETTER})|[sd](?![\p{{L}}\p{{N}}%]))|%\(\w+\)[sd](?!\p{{L}})|%%[\p{{L}}_ ]{{2,}}+%%",
    "hash": _after(r"[\p{L}\p{N}#]", "#") + rf"#?\p{{L}}[\p{{L}}_]{{2,}}+##?(?!{_LETTER})",
    "at": r"@@\p{L}[\p{L}_ ]++@@|" + _after(r"[\p{L}\p{N}.@]", "@") + r"[\p{Lu}_]{3,}+@",
    "crosses": _after(_LETTER, "(?:XXXX|xxxx|Xxxx)") + rf"[Xx]*(?!{_LETTER})",
    "date": _after(_LETTER, "(?:XX|xx)") + r"[/.\-](?:XX|xx)(?:[/.\-](?:20)?(?:XX|xx|\d\d))?" + f"(?!{_LETTER})|" + _after(_LETTER, "(?:DD|TT|JJ|GG)") + r"[/.\-]MM[/.\-](?:YY|JJ|AA)+" + f"(?!{_LETTER})",
    "dunder": _after(r"[\p{L}\p{N}_]", "__") + r"\p{L}(?:[\p{L}\p{N} ]|_(?!_))*+__(?![\p{L}\p{N}_])",
    "mark": _after(_LETTER, "(?:TBD|TBC|FIXME)") + rf"(?!{_LETTER})",
    "blank": r"_{3,}|(?<=20)__(?!\p{L})",
}

#: What a text must hold, one of each, for its grammar to be tried: a plain search is many times cheaper than a pattern.
_OPENINGS = {
    "double_brace": ["{{"], "template_tag": ["{%", "<%"], "dollar": ["${", "$("], "single_brace": ["{"], "double_square": ["[["], "square": ["["], "angle": ["<"], "capital_angle": ["<"],
    "guillemet": ["«"], "percent": ["%"], "hash": ["#"], "at": ["@"], "crosses": ["XXXX", "xxxx", "Xxxx"], "date": ["XX", "xx", "MM"], "dunder": ["__"], "mark": ["TBD", "TBC", "FIXME"], "blank": ["__"],
}

_CODE = r"(?s)```.*?```|~~~.*?~~~|<pre>.*?</pre>|<code>.*?</code>|(?<!`)`[^`\n]+`(?!`)"
#: Lines for signatures: a blank that ends a line after a colon, or fills a line, or stands beside another such.
_SIGNATURE = r"(?m)^[^\n_]*[:：][ \t]*_{3,}[ \t.]*\r?$|^[ \t]*(?:_{3,}[ \t]*)+\r?$|^[ \t]*(?:by|name|title|date|place|signature|signed|ort|datum|unterschrift|fait à|lieu|firma|fecha|luogo|data)\b[^\n_]*_{3,}[ \t]*\r?$"

#: What messages of servers, viewers and scripts speak of, and what they say of it, in five languages; lower case. Fixed values.
_THINGS = r"page|file|document|record|site|website|web site|server|host|gateway|service|session|login|log-?in|password|account|access|request|response|reply|connection|network|preview|viewer|browser|portal|application|content|resource|link|url|address|traffic|rights|permission|something|error|problem|maintenance|archive|seite|datei|dokument|server|dienst|sitzung|anmeldung|zugriff|anfragen?|verbindung|vorschau|browser|inhalt|fehler|wartungsarbeiten|page|fichier|document|serveur|service|session|accès|requêtes?|connexion|aperçu|navigateur|contenu|erreur|maintenance|página|archivo|documento|servidor|servicio|sesión|acceso|solicitud(?:es)?|conexión|navegador|contenido|error|mantenimiento|pagina|file|documento|server|servizio|sessione|accesso|richiest[ae]|connessione|anteprima|browser|contenuto|errore|manutenzione"
_FAILS = r"not found|not be found|cannot be found|does not exist|no longer exists?|moved|removed|deleted|denied|forbidden|not allowed|unauthori[sz]ed|lack|expired|no longer valid|invalid|timed out|time-?out|did not (?:reply|respond|answer)|not (?:responding|reachable|available)|unavailable|failed|failure|could not be (?:displayed|loaded|opened|shown|found)|cannot be (?:displayed|loaded|opened|shown)|went wrong|occurred|in progress|working on it|unusual|too many|bad|internal|unexpected|nicht gefunden|verschoben|gelöscht|verweigert|abgelaufen|nicht (?:erreichbar|verfügbar|rechtzeitig)|geantwortet|fehlgeschlagen|aufgetreten|zu viele|introuvable|déplacé|supprimé|refusé|expirée?|indisponible|pas répondu|échoué|survenue|trop de|en cours|no encontrad[ao]|movido|eliminado|denegado|caducad[ao]|no disponible|no respondió|producido|demasiadas|non trovat[ao]|spostato|rimosso|eliminato|negato|scadut[ao]|non disponibile|non ha risposto|verificato|troppe"
#: How they tell the reader what to do, at the beginning of a short piece. Fixed values.
_ADVICE = r"(?:please |bitte |veuillez |por favor,? )?(?:we(?:'|’| a)re working on|try again|retry|reload|refresh|sign in|log in|go back|return to the (?:start|home)|back to (?:the )?(?:start|home)|contact (?:the |your )?(?:helpdesk|support|administrator|webmaster)|ask your administrator|search the|come back|wait a|click here|clear your|check (?:the|your) (?:url|address|connection|browser)|erneut versuchen|versuchen sie es|melden sie sich|zur startseite|laden sie die seite|aktualisieren sie|réessayer|réessayez|vous reconnecter|reconnectez|retour à l|rechargez|revenez|reintentar|inténtelo|vuelva a|inicie sesión|volver al|recargue|riprovare?|riprova|accedere di nuovo|accedi|torna(?:re)? (?:alla|all)|ricaricare?|poi ricaricare|después vuelva)"
#: What requests to enable scripts speak of. Fixed values.
_SCRIPTS = r"java ?scripts?|scripts?|scripting|cookies|browsers?|skripte|scripts|navigateur|navegador"
_SCRIPT_ASKS = r"enable|turn on|switch(?:ed)? off|disabled|required|requires?|needs?|need to|must be on|allow|supported|checking|active|aktivieren|benötigt|erforderlich|activer|exige|nécessaire|activ[ae]|necesita|requiere|attivare|attiva|richiede|necessario"
#: Who speaks in a contract: a piece that names them or a place in it is no message. Fixed values.
_LEGAL = r"\b(?:shall|section|clause|article|schedule|annex|party|parties|licensee|licensor|seller|buyer|purchaser|lender|borrower|tenant|landlord|supplier|provider|customer|ziffer|anlage|artikel|partei|käufer|verkäufer|mieter|vermieter|lieferant|annexe|vendeur|acheteur|bailleur|preneur|cláusula|anexo|artículo|vendedor|comprador|arrendador|clausola|articolo|allegato|venditore|acquirente|locatore)\b|§"
#: The forms messages come in, and filler and test input, as they begin a line or sentence; lower case. Fixed values.
PHRASES = [
    r"not found$", r"forbidden$", r"unauthori[sz]ed$", r"reference:? [0-9a-f]{6,}", r"\([45]\d\d/[0-9a-f]{4,}\)", r"(?:error|http|status|fehler|erreur|codice|código)? ?[45]\d\d\b(?!\.\d)", r"traceback\b", r"(?:step|at|in|file) \S+,? line \d+", r"\w+(?:reset|timeout|problem|error|exception): ", r"home [|·]", r"\w+ archive$", r"\{\"(?:status|code|error)\": ?\"?[45]\d\d", r"<(?:!doctype|html|noscript)\b",
    r"loading\s*(?:…|\.\.\.)", r"wird geladen", r"chargement", r"cargando", r"caricamento",
    r"sample (?:document|paragraph|text)", r"for demonstration, no content", r"this page was created to test", r"test (?:document|page|input|text|upload)\b", r"dummy (?:wording|text)", r"your heading here", r"text of the clause goes here", r"(?:your )?text (?:goes )?here", r"platzhaltertext", r"blindtext", r"hier steht", r"texte? (?:de remplissage|provisoire|fictif)", r"texto de (?:relleno|ejemplo|prueba)", r"testo (?:segnaposto|di prova|di esempio|fittizio)", r"content to follow", r"body text", r"lorem ipsum", r"(?:paragraph|heading|bullet|item|clause title|clause) \d+$", r"\d+\. (?:heading|bullet|item|clause title|paragraph|section|title) \d+$", r"tbd\.?$", r"tba\.?$", r"[….\s]+$", r"do not index\b",
]
_PHRASE = "^(?:" + "|".join(PHRASES) + ")"
#: What may stand before a phrase in its piece.
_LEAD = r"[\s\p{Z}\p{Cf}#*\-–>|•\"“]"
_QUOTED = r"“[^”]*”|«[^»]*»|„[^“”]*[“”]"

#: The vocabulary of pseudo-Latin filler. Fixed values.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua donec fusce integer mauris nulla nisi ornare porta pulvinar sapien semper turpis varius velit vitae egestas feugiat lectus libero dictum vestibulum viverra quis nunc nam in ac at id eu vel non est enim urna massa justo tellus augue risus purus cras morbi proin aenean".split()
_KEYS = r"^(?:[asdfghjklöä]+|[qwertzuiopüy]+|[yxcvbnm]+|[asdfghjklöäqwer]+)$"
_BARE = r"[\s\p{Z}\p{Cc}\p{Cf}]"


def open_fields(text: Column) -> Column:
    """Array of the names of the grammars that find an open field in text."""
    coded = text.rlike("`|~~~|<pre>|<code>")
    plain = F.when(coded, F.regexp_replace(text, _CODE, " ")).otherwise(text)
    prose = F.when(F.contains(text, F.lit("__")), F.regexp_replace(plain, "(?i)" + _SIGNATURE, " ")).otherwise("")
    holds = lambda n: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in _OPENINGS[n]])
    tests = [F.when(holds(n) & (prose if n == "blank" else plain).rlike(g), F.lit(n)) for n, g in FIELD_GRAMMARS.items()]
    return F.array_compact(F.array(*tests))


def is_message(text: Column, density: float = DENSITY) -> Column:
    """Whether at least density of the letters and digits of text stand in pieces of messages or filler.

    Pieces are looked at from the first on until the rest cannot matter: most texts are told by their first quarter.
    """
    low = F.lower(text)
    size = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}\p{N}…]+", ""))
    bare = lambda p: F.regexp_replace(p, rf"^{_LEAD}+|[\s\p{{Z}}\p{{Cf}}]+$", "")
    pieces = F.split(low, r"\r?\n|(?<=[.!?…])\s+|(?<=</?(?:title|h1|p|head|body|html)>)")
    word = lambda p, ws: p.rlike(rf"\b(?:{ws})\b")
    says = lambda p: p.rlike(rf"(?:^|[,;] ){_ADVICE}\b") | (word(p, _FAILS) & word(p, _THINGS)) | (word(p, _SCRIPTS) & word(p, _SCRIPT_ASKS))
    message = lambda p: let(F.regexp_replace(p, _QUOTED, " "), F.lit(False), says)
    hit = lambda p: p.rlike(_PHRASE) | (~p.rlike(_LEGAL) & message(p))

    def judge(total: Column) -> Column:
        spare = total * (1 - density)
        missed = F.aggregate(pieces, F.lit(0), lambda m, p: F.when(m > spare, m).otherwise(m + let(bare(p), F.lit(0), lambda b: F.when(hit(b), 0).otherwise(size(b)))))
        return (total > 0) & (missed <= spare)

    return F.coalesce(let(size(low), F.lit(False), judge), F.lit(False))


def is_filler(text: Column) -> Column:
    """Few different words, or nearly all from a filler vocabulary, or typed on neighbouring keys."""
    no = F.lit(False)

    def by_words(words: Column) -> Column:
        n = F.size(words)
        share = lambda test: F.size(F.filter(words, test)) / n
        few = (n >= 5) & (F.size(F.array_distinct(words)) <= 2)
        latin = (n >= 5) & (share(lambda w: w.isin(*LATIN)) >= 0.8)
        keys = (n >= 3) & (share(lambda w: w.rlike(_KEYS)) >= 0.9)
        return F.when(n > 0, few | latin | keys).otherwise(no)

    def by_pieces(pieces: Column) -> Column:
        return (F.size(pieces) >= 3) & (F.size(F.array_distinct(pieces)) == 1)

    low = F.lower(text)
    pieces = F.filter(F.transform(F.split(low, r"\r?\n|(?<=[.!?…])\s+"), lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}]+", "")), lambda p: p != "")
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.coalesce(let(pieces, no, by_pieces) | let(words, no, by_words), no)


def residue(docs: DataFrame, text: str = "text", density: float = DENSITY) -> DataFrame:
    """docs with fields (array of grammars that hit), message, filler, and residue: whether to leave the text out."""
    t = F.col(text)
    says = F.regexp_replace(t, _BARE, "") != ""
    out = docs.withColumns({"fields": open_fields(t), "message": is_message(t, density), "filler": is_filler(t)})
    return out.withColumn("residue", F.coalesce(says & ((F.size("fields") > 0) | F.col("message") | F.col("filler")), F.lit(False)))
