"""Template residue, filler text, error pages and script notices in documents.

1. *Mask.* Texts are cleaned of markup, unfilled slots are replaced by a mark, numbers,
   addresses, dates and ids by fixed words, and the text is cut into messages (lines and
   sentences) of folded lower-case letters.
2. *Group.* Messages that hold any word of notices or any placeholder are reduced to one
   row a document and grouped by exact hash: in how many documents and sources does each
   stand? (A message without such a word can't be classified, so its group is not made.)
3. *Classify* each distinct message once, by phrase and placeholder rules of three grades:

   * 3, *placeholder*: an unfilled slot, a form prompt, filler Latin. Decides alone.
   * 2, *wording*: the message as a whole has the wording of a notice, an error or filler, or
     is a labelled blank field. Decides if it recurs (``MIN_DOCS`` documents of ``MIN_SOURCES``
     sources), comes twice or beside another graded message in the same document, or makes
     up half of the document.
   * 1, *topic*: a short message that names a page or script and a failure or demand.
     Decides only if it recurs.
   * 0, *frame*: what stands around notices, such as navigation and advice to retry. Never
     decides, but supports a wording.

A message that quotes such a thing, shows it as code or talks about it has no grade. The
rules are regular expressions without look-around, which the SQL that checks them shares.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.staging import spread
from folioforge.session import cut_lineage

MIN_DOCS, MIN_SOURCES = 3, 2
#: most words of a notice that scripts are required or of filler, and of a message graded by topic alone
NOTICE_WORDS, TOPIC_WORDS = 20, 12
#: the classified messages are copied this often, so that a message in a third of all documents meets them in as many tasks
SALTS = 16
SLOT, BARE = "\x01", "\x02"

# --- fixed values: wordings ---------------------------------------------------------------
# Patterns are matched against lower-case text whose runs of non-ASCII characters are folded
# to one "_", so that broken encodings of accented letters match as well. "_" in a pattern
# also matches one unaccented letter.

OPENERS = (
    r"sorry", r"we're sorry(,? but)?", r"oops", r"error", r"warning", r"notice", r"hmm", r"leider", r"hoppla", r"fehler", r"hinweis", r"d_sol_",
    r"request blocked", r"interner serverfehler", r"oups", r"erreur( du serveur)?", r"lo sentimos", r"_?vaya", r"error del servidor", r"serverfehler", r"attention", r"achtung", r"aviso",
)

SCRIPT_WORD = r"\b(java ?script|js|scripts?|scripting|skripte?n?|skriptunterst_tzung|noscript)\b"
#: what a notice says of scripts
SCRIPT_STATE = (
    r"\b(enable[ds]?|activate[ds]?|turn(ed)? o(n|ff)|switch(ed)? o(n|ff)|allow(ed)?|unblock|required?|requires|needs?|needed|must|blocks?|blocked|blocking|blocker|disabled?|supports?|without|works?|"
    r"active|necessary|off|runs?|aktiv\w*|deaktiv\w*|erlauben|schalten|erforderlich|n_tig|ben_tigt|blockiert|(aus|ein|ab)geschaltet\w*|l_uft|unterst_tzt|activ\w+|d_sactiv\w*|n_cess\w*|requis|requiert|bloqu\w*|"
    r"autoris\w+|sans|exige|prend pas|habilit\w*|deshabilit\w*|necesari\w+|necesita|requiere|permita|desactiv\w*|admite|ohne|sin)\b"
)
#: words by which a page speaks of itself or to its reader
ADDRESS = (
    r"\b(please|you|your|this|page|site|website|app|application|forum|viewer|service|submission|reviews?|comments?|content|portal|browser|bitte|ihr|sie|diese|seite|anwendung|veuillez|votre|ce|cette|"
    r"vous|navigateur|l'affichage|su|esta|este|sitio|p_gina|foro|aplicaci_n|navegador|por favor|active|scripts (are|is|sind|sont|est_n))\b|^(enable|turn|switch|allow|activate|disable|js|java ?script|scripting)\b"
)

STATUS_REASON = (
    r"(not found|unauthori[sz]ed|forbidden|gone|request time-?out|too many requests|internal server error|bad gateway|bad request|"
    r"service (temporarily )?unavailable|gateway time-?out|payment required|method not allowed|not acceptable|conflict)"
)
#: error messages; each is a whole message from its start
ERROR_NOTICE = (
    rf"(http/[\d.]+ |error |status |code |fehler |erreur )*#? ?0? ?[:\-]? ?{STATUS_REASON}[.!]?",
    rf"(error|http|status|code|fehler|erreur) ?(code )?0 ?[:\-]? ?.{{0,40}}",
    r'\{ ?"(error|ok|detail|status|message|code|name|type)" ?:.*"?(error|message|status|detail|reason|code)"? ?:.*',
    r"upstream connect error.*",
    r"[a-z][a-z-]{2,20}/0( \([a-z0 ]{2,20}\))?",
    r"traceback \(most recent call last\).*",
    r'file ".*", line 0, in .*',
    r"\w*(error|exception): .*",
    r"(request|incident|ray|trace|correlation) id:? [0-9a-f\-]+",
    r"(access|permission) (is |was )?denied\b.{0,60}",
    r"you (do not|don't) have (permission|access)\b.*",
    r"you are not (allowed|authori[sz]ed)\b.*",
    r"too many requests from\b.*",
    r"(your|the|this) session (has )?(expired|timed out)\b.*",
    r"(please )?log ?in (again|to continue|to (see|view|read|access))\b.*",
    r"login (is )?required\b.*",
    r"unusual (traffic|activity)\b.*",
    r"(please )?(complete|solve|pass) the (security check|captcha)\b.*",
    r"(please )?(prove|confirm|verify) that you are (a )?human\b.*",
    r"no such (submission|page|paper|file|note|document|forum)\b.{0,30}",
    r"(the )?(requested )?(page|paper|submission|note|document|file|url|link)( that)? (you (are|were) looking for|you (requested|followed)|requested) .*",
    r"(the )?(requested )?(page|paper|submission|note|document|file|url) (was|is|could|can) (not |no longer |n't )(be )?(found|available|exist|load).*",
    r"page not found\b.{0,60}",
    r"(the )?(page|paper|submission|forum|note|document|file|review) \S+ (is|was|has been|could not be|cannot be|does not|doesn't) (missing|moved|deleted|removed|not found|found|withdrawn|exist|unavailable|loaded|opened|available)\b.*",
    r"we (could|can|were) ?(not|n't|unable to) (load|open|find|fetch|display|retrieve|process) (the |this |your )?(forum|page|paper|submission|note|document|file|reviews?|comments?|content|pdf|request)\b.*",
    r"(the )?(pdf |page |document )?(viewer|reader|browser|plug-?in|renderer) (has )?(crashed|stopped|failed|quit)\b.*",
    r"(the )?(\w+ )?(parser|converter|extractor|worker|process|job|renderer) (exited|terminated|died|crashed)\b.*",
    r"(this|the) (service|site|page|server|system)( is| was)? (currently |temporarily )?(down|unavailable|offline|under maintenance|undergoing)\b.*",
    r"something went wrong\b.{0,60}",
    r"an? (unexpected |unknown |internal |server )?error (has )?occurred\b.*",
    r"(the )?database connection (was )?(lost|failed|refused)\b.*",
    r"(\w+ )?worker timed out\b.*",
    r"(conversion|parsing|extraction|rendering|ocr|download) (failed|error|aborted)\b.*",
    r"(could|can) ?not (open|load|parse|read|fetch|convert) (the |this )?(pdf|page|file|document|reviews?|comments?)\b.*",
    r"click here if you are not redirected.*",
    r"(you are being|you will be) redirected\b.*",
    r"(access|acc_s|acceso) (refus_|denegado|interdit|prohibido)\S{0,2}( .{0,30})?",
    r"zugriff verweigert.{0,30}",
    r"sie haben keine berechtigung\b.*",
    r"(diese|die|die angeforderte|die gesuchte) seite (existiert|wurde|konnte|ist) (nicht|leider nicht)\b.*",
    r"(die|der|das) (angeforderte|gesuchte|gew_nschte)[rsn]? \w+ (\S+ )?(existiert|wurde|ist|konnte) (leider )?nicht\b.*",
    r"seite nicht gefunden.{0,30}",
    r"(es|leider) ist ein (unerwarteter |interner )?fehler aufgetreten.*",
    r"ihre sitzung ist abgelaufen.*",
    r"(bitte )?melden sie sich (erneut|neu|wieder|bitte) ?(an)?\b.*",
    r"zu viele anfragen von\b.*",
    r"(der|dieser) (dienst|server) (wird|ist) (gerade |derzeit |zurzeit |momentan )?(gewartet|nicht (verf_gbar|erreichbar)|in wartung).*",
    r"(die|cette|la) page (demand_e?|recherch_e?|que vous (cherchez|demandez))? ?(est introuvable|n'existe (pas|plus)|n'a pas _t_ trouv_e?).*",
    r"page (introuvable|non trouv_e?)\b.{0,30}",
    r"une erreur (est survenue|s'est produite|inattendue)\b.*",
    r"(votre|la) session a expir_.*",
    r"(veuillez )?(vous )?reconnect(er|ez)(-vous)?\b.*",
    r"trop de requ_tes\b.*",
    r"(ce|le) service est (actuellement |temporairement |momentan_ment )?(en maintenance|indisponible).*",
    r"(le|la|ce|cette) (document|page|article|soumission|note|fichier|avis) (\S+ )?(a _t_|est|n'existe)\b.{0,30}(d_plac|supprim|introuvable|retir|pas\b|plus\b).*",
    r"vous n'avez pas (acc_s|l'autorisation|la permission|le droit)\b.*",
    r"no se (encontr_|ha encontrado|pudo encontrar) (la|el) (p_gina|documento|env_o|art_culo)\b.*",
    r"p_gina no encontrada\b.{0,30}",
    r"(el|la) (env_o|documento|p_gina|art_culo|nota|archivo|foro) (\S+ )?(no existe|no se encuentra|no est_ disponible|ha sido (eliminad|movid)|fue (eliminad|movid)).*",
    r"(se ha producido|ha ocurrido|se produjo|ocurri_) un error\b.*",
    r"su sesi_n ha (caducado|expirado)\b.*",
    r"(vuelva a iniciar|inicie) sesi_n\b.*",
    r"demasiadas (solicitudes|peticiones)\b.*",
    r"(este|el) servicio (est_|no est_) (en mantenimiento|disponible|fuera de servicio).*",
    r"no tiene (permiso|acceso|autorizaci_n)\b.*",
)

#: names of dummy texts: (adjective, noun), in any of the languages
FILLER_ADJECTIVE = r"(dummy|sample|placeholder|filler|example|blind|fake|beispiel|platzhalter|f_ll|muster)"
FILLER_NOUN = r"(text|sentence|paragraph|abstract|content|title|satz|absatz)"
#: filler wordings; each is a whole message from its start
FILLER_NOTICE = (
    rf"(this is (a |the )?)?{FILLER_ADJECTIVE}[ -]?{FILLER_NOUN}\b.{{0,60}}",
    r"(texte|phrase|paragraphe) (de d_monstration|d'exemple|fictif|provisoire|de remplissage)\b.{0,60}",
    r"(texto|frase|p_rrafo) (de (ejemplo|relleno|muestra|prueba)|provisional)\b.{0,60}",
    r"(your|the) (abstract|text|summary|review|content|title|description) goes here[.!]?",
    r"here (comes|goes|will be) (the|your) (abstract|text|summary|review|content|title)[.!]?",
    r"(insert|add|put|enter) (your )?(content|text|abstract|summary|title)( here)?[.!]?",
    r"some words to show\b.{1,40}",
    r"(first|second|third|next|last|another) (sentence|paragraph) of the (section|text|abstract|paragraph)[.!]?",
    r"this (text|paragraph|sentence) only (fills|is here to fill|serves)\b.{1,40}",
    r"hier (steht|folgt|kommt) (sp_ter |bald |dann )?(der|die|das|ein) (text|titel|inhalt|zusammenfassung|abstract)\b.{0,10}",
    r"(ici (viendra|figurera|se trouvera)|ici,? bient_t) (le|la|votre) (r_sum_|texte|titre|contenu)\S{0,2}",
    r"(aqu_ (ir_|va|vendr_|aparecer_)) (el|la|su) (resumen|texto|t_tulo|contenido)[.!]?",
)

#: form fields and their prompts, placeholders wherever they stand
FIELD = (
    r"click (or tap )?(here )?to enter (your )?(text|answer)", r"type your (answer|text|response|comments?) here", r"replace this (paragraph|text|sentence) with your own (words|text)",
    r"your one-sentence summary", r"\((to be completed|to be filled in|to be filled) by [a-z ]{3,30}\)", r"\(choose (one|an option)\)", r"\[(please )?select( one)?\]",
    r"\[(yes|ja|oui|s_|si)/(no|nein|non)\]", r"_ ?(yes|ja|oui|s_|si) ?_ ?(no|nein|non)\b", r"<enter [a-z ]{2,30}>", r"\[please [a-z ,'-]{5,80}\]", r"\(max\. ?0 (characters|words)[a-z, ]{0,20}\)",
    r"\(bitte (w_hlen|ausw_hlen|ankreuzen)\)", r"\[(bitte )?(text|antwort) (eingeben|einf_gen)\]", r"\((choisir|choisissez|s_lectionner|s_lectionnez) [a-z' \x5f]{2,30}\)", r"\[(saisir|entrer|saisissez|entrez) [a-z' \x5f]{2,20}\]",
    r"\((elija|elegir|seleccione|seleccionar) [a-z \x5f]{2,20}\)", r"\[(escriba|escribir|introduzca|introducir) [a-z \x5f]{2,20}\]",
)
#: blank form fields, beside a label at the start of their line
THIN_FIELD = (
    r"_{4,}", r"\.{6,}", r"write here", r"hier schreiben", r"bitte ausf_llen", r"_crire ici", r"_ compl_ter", r"_ remplir", r"escribir aqu_", r"completar", r"rellenar", r"por completar", r"_",
)

#: what a page has and what fails: a short message with one of each has the topic of an error page
THING = (
    r"\b(pages?|site|website|paper|submission|note|document|file|url|link|forum|reviews?|comments?|session|service|server|requests?|access|log ?in|account|viewer|parser|worker|process|job|conversion|"
    r"download|upload|database|connection|network|browser|gateway|pdf|content|loading|cookies|seite|dokument|datei|einreichung|sitzung|dienst|anfragen?|zugriff|verbindung|navigateur|acc_s|fichier|"
    r"soumission|connexion|requ_tes|serveur|p_gina|env_o|archivo|sesi_n|servicio|solicitud(es)?|acceso|servidor|navegador|conexi_n)\b"
)
FAILURE = (
    r"\b(not found|moved|deleted|expired|denied|refused|forbidden|unavailable|unauthori[sz]ed|crashed|broken|failed|fails|failure|timed out|timeout|does not exist|no such|could not|cannot|can't|"
    r"couldn't|unable|no longer|not allowed|too many|went wrong|error (has )?(occurred|while|code)|exited|unexpected|blocked|lost|reload|refresh|try again|maintenance|redirected|captcha|nicht gefunden|existiert nicht|abgelaufen|"
    r"verweigert|fehler (ist|beim)|fehlgeschlagen|wartung|erneut|introuvable|expir_e?|refus_e?|indisponible|erreur (est|s'est|lors)|r_essayez|rechargez|supprim_e?|no encontrada?|no existe|caducado|expirado|denegado|"
    r"mantenimiento|recargue)\b"
)

#: navigation and references around a notice, as a whole message
FRAME = (
    r"(menu|home|start|inicio|accueil|login|sign in|search|browse)( ((\||\x5f+) )?\w+){0,4}", r"\w+( (\||\x5f+) \w+){1,4}", r"skip to (main )?content", r"back to .{1,20}", r"zum inhalt springen", r"zur_ck zur? .{1,20}",
    r"volver al? .{1,20}", r"retour . .{1,20}", r"aller au contenu", r"ir al contenido", r"powered by [\w.-]+", r"contact [^ ]+@[^ ]+", r"(ref|reference|referencia|r_f_rence|referenz|request id|incident|ray)[: #]*0",
)
#: advice to a reader whose page failed, at the start of a message
ADVICE = (
    r"(please )?(try again|reload|refresh|go back|use the search|log ?in again|contact (support|the)|check your|if the problem persists|then (refresh|reload)|change the browser|allow .{1,20} and reload|r_essayez|rechargez|"
    r"utilisez la recherche|v_rifiez|reconnectez|int_ntelo|recargue|vuelva|vuelve|use la b_squeda|despu_s recargue|revise|compruebe|pr_fen sie|laden sie|melden sie|versuchen sie|nutzen sie|bitte versuchen)"
)

#: filler Latin
LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisci elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum porro quaerat temporibus risus "
    "mattis pulvinar donec vitae nam eius fuga quisquam numquam modi dolorem aspernatur aut odit perspiciatis unde omnis iste natus error voluptatem accusantium "
    "doloremque laudantium totam rem aperiam vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas viverra integer nec "
    "faucibus ornare suspendisse interdum rutrum tellus rerum vel rerum vel rerum vel rerum vel rerum vel"
)

#: unfilled slots in the raw text: double or marked brackets around a name, dummy values
STRONG_SLOT = (
    r"\{\{ ?[A-Za-z_][\w .-]{1,40} ?\}\}", r"[$#]\{ ?[A-Za-z_][\w.-]{2,40} ?\}", r"\{% ?[A-Za-z_][\w ]{1,40}%\}", r"<%=? ?[A-Za-z_][\w .]{1,40}%>",
    r"\[\[ ?[A-Za-z_][\w ]{1,40}\]\]", r"%%[A-Za-z_]{3,40}%%", r"%[A-Z][A-Z_]{2,40}%", r"%\([A-Za-z_]{2,40}\)[sdrf]", r"@@[A-Za-z_]{3,40}@@", r"<<[A-Za-z_ ]{2,40}>>",
    r"<(?:insert|enter|your|add)[ _][A-Za-z_ ]{2,40}>", r"<[A-Z]{3,}(?:[ _][A-Z]{2,})*>", "\u00ab[A-Z]{3,}(?:_[A-Z]{2,})*\u00bb",
    r"\[(?:INSERT|ENTER|ADD|YOUR)[ _][A-Z_ ]{2,40}\]", r"\[(?:TODO|TBD|FIXME|TK)\b[^\[\]\n]{0,60}\]", r"\[[A-Z][A-Z ]{2,30}: ?(?:add|insert|fill in)[^\[\]\n]{0,40}\]",
    r"\[[A-Za-z_ ]{2,40} goes here\]", r"\[(?:insert|insertar|ins\u00e9rer|inserir|indicar) [\w ]{2,40}\]", "\\[hier [\\w ]{2,40} (?:einf[^ \\]]{1,4}gen|eintragen|erg[^ \\]]{1,4}nzen)\\]",
    r"\b[Dd]ear (?:undefined|null|NaN|None)\b", r"\b(?:by|from) (?:undefined|null|NaN) (?:on|at|for)\b",
    "\\[[^\\[\\] \\n]{1,5} compl[^ \\]]{1,3}ter ?:? ?[\\w ]{0,40}\\]", r"\[(?:Your|My) [A-Z][\w' ]{1,40}\]",
    r"\bX{1,3}\.X{1,3}\b ?%?", r"\b(?:first\.?name[._]last\.?name|first\.last|your[._]?name|user\.?name)@[\w.]+",
)
#: slots that count only between certain neighbours: (before, slot, after)
HEDGED_SLOT = (
    (r"(^|[^\w/.])", r"__[A-Z]{2,}(?:_[A-Z]+)*__", r"([^\w(]|$)"),
    (r"(^|[^-/\w])", r"(?:N{3,}|Y{4}|X{3,})", r"([^-/\w]|$)"),
    (r"(^|\n|[.!?] )", r"(?:TODO|TBD|FIXME)(?: ?[:\-]| (?:write|add|fill|insert|check|update|cite|describe|explain|complete|finish|rewrite|discuss)\b)", r"()"),
)
#: slots that formulas and code use as well: only as a whole word of running prose
BARE_SLOT = (
    (r"(^|[^\\_^$#%{\w})\]])", r"\{(?:[A-Za-z]{3,}(?:_[a-z]+)*|\d)\}", r"([^{_^\w(]|$)"),
    (r"()\b", r"[QA]\{\w+\}:", r"()"),
)
#: a message without any of these has no slot
SLOT_SIGNS = ("{", "<", "[", "%", "@", "\u00ab", "__", "XXX", "X.X", "NNN", "YYYY", "TODO", "TBD", "FIXME", "undefined", "null", "NaN", "None")

#: sentences that speak of templates, markup or crawling rather than being residue
SUBJECT = (
    r"\b(prompts?([^\w-]|$)|templates? engine|gabarit|plantilla|schablone|formular|special tokens|tokenizer|jeton|symbol|config|the macro|preamble|wrapped|formatting|rendered|render time|"
    r"type signature|shell call|regex|delimiters?|we replace the|placeholder token)\b"
)
DISCUSSION = (
    r"\b(participants?|crawl(er|ed|s)?|corpus|corpora|korpus|classifier|klassifikator|subjects|deduplication|coverage|retried|analy[sz]ed separately|were (removed|discarded|dropped|excluded)|"
    r"was (removed|replaced)|we (show|measure|quote|replace|exclude|remove|filter|study|drop|treat|count|handle|report|find|propose|collect)|excluons|descartaron|excluimos|verwerfen|filtern|backoff|fetches|"
    r"reviewers complained|have since replaced|rubric|percent of|flagged)\b"
)

_TAGS = (
    r"(?i)</?(?:p|br|div|span|b|i|em|strong|u|a|li|ul|ol|h[1-6]|html|head|body|title|noscript|table|tr|td|th|pre|code|section|article|main|center|hr|font|sup|sub)"
    r"(?:[ \t\n]+[a-zA-Z-]+ ?= ?[^<>]{0,200})?[ \t\n]?/?>"
)
ENTITIES = (("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
#: curly quotes, special spaces and control characters, and what they become (nothing where the second is shorter)
#: words with a capital inside are names or ids
ID_RE = r"\b[A-Za-z]*[a-z][A-Z][A-Za-z]*\b"
ODD, PLAIN = "\u201c\u201d\u201e\u2018\u2019\u00a0\u3000\u2003\u2009\u200b\t\r\x00\x01\x02\x0b\x0c", "\"\"\"''" + " " * 7
#: ends of messages: line breaks and spaces behind the end of a sentence
SPLIT = r"\n|(?<=[.!?]) +"
#: masks in order: pattern, replacement, on folded lower-case text, whose digits are all 0
MASKS = (
    (r"https?://[^ \n]+|www\.[^ \n]+", "url"),
    (r"\b0000-00-00(?:[t ]00:00(?::00)?z?)?\b|\b00?[./]00?[./]0{2,4}\b", "0"),
    (r"\b[0a-f]{6,}(?:-[0a-f]{2,})*\b", "0"),
    (r"0+(?:[.,]0+)*", "0"),
    (r" +", " "),
)
QUOTED = r'"[^"]*"|`[^`]*`'


def _fold(pattern: str) -> str:
    """In a wording, "_" stands for a folded or an unaccented letter."""
    return pattern.replace("_", "[_a-z]{1,2}")


def _any(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


_LEAD = r"^(?:(?:" + "|".join(OPENERS) + r")[ ,:.!\-]+)*"
SCRIPT_RE, STATE_RE, ADDRESS_RE = _fold(SCRIPT_WORD), _fold(SCRIPT_STATE), _fold(ADDRESS)
ERROR_RE = _fold(f"{_LEAD}(?:{_any(ERROR_NOTICE)})$")
FILLER_RE = _fold(f"{_LEAD}(?:{_any(FILLER_NOTICE)})$")
FIELD_RE = "|".join(p if p.startswith("_ ?(yes") else _fold(p) for p in FIELD)
THIN_RE = r"^[a-z][a-z;/' _-]{2,40}(?:[:?]| -) *(?:" + "|".join(p if p in ("_{4,}", "_") else _fold(p) for p in THIN_FIELD) + r")[.]?$"
THING_RE, FAILURE_RE = _fold(THING), _fold(FAILURE)
FRAME_RE = _fold(f"^(?:{_any(FRAME)})[.!]?$|^(?:{ADVICE})")
ABOUT_RE = f"{SUBJECT}|{DISCUSSION}"
LATIN_RE = r"\b(?:" + "|".join(sorted(set(LATIN.split()))) + r")\b"
LATIN_START = r"^[^a-z]*(?:[^ ]+ )?(?:{0})[ ,.]+(?:{0})\b".format("|".join(sorted(set(LATIN.split()))))
#: a message has no grade unless a word of it starts like this, or a sign below stands in it
HINT_WORDS = (
    "javascript|java script|js|script|noscript|skript|file \"|error:|exception:|erreur|error 0|error has|error while|error code|error occurred|server error|serverfehler|fehler|traceback|not found|gone|bad request|"
    "payment required|method not|not acceptable|conflict|denied|refus_|verweigert|denegado|interdit|prohibido|forbidden|unauthori|authori|autori|expire|expir_|abgelaufen|caducad|login again|log in again|"
    "login required|log in to|login to|melden sie|reconnect|sesi_n|sitzung|too many|zu viele|trop de|demasiad|captcha|security check|are human|are a human|redirected|service |temporarily |currently |unavailable|"
    "indisponible|is down|was down|is offline|maintenance|wartung|gewartet|mantenimiento|gateway|timeout|time-out|timed out|crashed|exited|terminated|died|failed|aborted|is missing|was missing|moved|deleted|"
    "withdrawn|no such|cannot|can't|could not|couldn't|can not|unable|no longer|does not|doesn't|permission|berechtigung|permiso|allowed|upstream|unusual|went wrong|broken|unexpected|occurred|connection|reload|"
    "refresh|try again|loading|cookies|request id|incident|trace|correlation|existi|existe|gefunden|wurde nicht|wurden nicht|erreichbar|introuvable|trouv_|supprim_|retir_|n'est plus|encontr_|disponible|movid|"
    "eliminad|acceso|acc_s|aufgetreten|survenue|produit|ocurri_|producido|dummy|placeholder|filler text|filler sentence|filler paragraph|sample text|sample sentence|sample paragraph|sample abstract|sample title|"
    "sample content|example text|example sentence|example paragraph|example abstract|example title|blind text|blindtext|fake |beispieltext|beispielsatz|platzhalter|f_lltext|mustertext|texte de|texte d'|"
    "texte fictif|texte provisoire|phrase de|phrase d'|paragraphe de|paragraphe d'|texto de|texto prov|frase de|p_rrafo de|goes here|here comes|here goes|here will|some words|sentence of the|paragraph of the|"
    "only fills|only serves|is here to|hier steht|hier folgt|hier kommt|ici viendra|ici figurera|ici se|ici bient_t|ici, bient_t|aqu_|click |type your|replace this|your one|to be completed|to be filled|"
    "write here|hier schreiben|bitte|completar|rellenar|skip to|back to|zum inhalt|zur_ck|retour|aller au|ir al|powered|contact |go back|if the problem|then refresh|then reload|change the browser|r_essayez|"
    "rechargez|utilisez|v_rifiez|int_ntelo|recargue|vuelva|compruebe|pr_fen|laden sie|versuchen sie|nutzen sie|crire ici|escribir aqu_|remplir|compl_ter|ausf_llen"
)
#: or it starts like this
HINT_START = (
    "the page |the paper |the submission |the forum |the note |the document |the file |the review |page |paper |insert |add |put |enter |search |select |browse |menu|home|start |inicio|accueil|sign in|login|log in|"
    "ref|r_f|check your|active |use |volver|vuel|revise|this page|this paper|la page|le document|el env_o|el documento|die seite"
)
HINT_SIGNS = (SLOT, BARE, "____", "......", '{"', "{ \"", " | ", ": _", "- _", "? _")


def _trie(stems: str) -> str:
    """One pattern for many stems, each letter of which is tried once."""

    def branch(words: list[str]) -> str:
        by_first: dict[str, list[str]] = {}
        for w in words:
            by_first.setdefault(w[:1], []).append(w[1:])
        if "" in by_first:
            return ""  # a stem that ends here makes the longer ones superfluous
        parts = [(_fold(c) if c == "_" else re.escape(c)) + branch(rest) for c, rest in sorted(by_first.items())]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return branch(stems.split("|"))


WORDS_RE = rf"\b{_trie(HINT_WORDS)}"
START_RE = rf"^(?:{_trie(HINT_START)}|[a-z-]+/0|\x5f|((?:[a-z]+ ){{1,3}}?)\1\1)"
CHOICE_RE = r"[(\[<_] ?(?:please|choose|select|choisi|s|eli|escrib|introdu|entr|yes|ja\b|oui|max|bitte|text|antwort|enter)"


def hinted(mask: Column) -> Column:
    """Whether any rule may fit the masked message."""
    signs = mask.contains(HINT_SIGNS[0])
    for sign in HINT_SIGNS[1:]:
        signs = signs | mask.contains(sign)
    return signs | mask.rlike(WORDS_RE) | mask.rlike(START_RE) | mask.rlike(CHOICE_RE) | mask.rlike(LATIN_START)


def messages(docs: DataFrame) -> DataFrame:
    """doc_id, source, ``size`` of the document, ``mask`` and ``chars`` of every message that some rule may fit.

    Each step hands over through a generator, so that the optimiser doesn't repeat it in
    every rule that reads its result; numbers are masked only where a hint was found."""
    source = F.coalesce(F.regexp_replace(F.lower(F.trim("source")), "[-_ ]+", "_"), F.lit(""))
    x = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", source.alias("source"), F.explode(F.array(clean(F.col("text")))).alias("t"))
    x = x.select("doc_id", "source", F.length(F.trim("t")).alias("size"), F.explode(F.split("t", SPLIT)).alias("m"))
    x = x.where(F.trim("m") != "")
    signs = F.col("m").contains(SLOT_SIGNS[0])
    for sign in SLOT_SIGNS[1:]:
        signs = signs | F.col("m").contains(sign)
    x = x.withColumn("m", F.explode(F.array(F.when(signs, mark_slots(F.col("m"))).otherwise(F.col("m")))))
    x = x.withColumn("m", F.explode(F.array(folded(F.col("m"))))).where(hinted(F.lower("m")))
    return x.select("doc_id", "source", "size", F.length("m").alias("chars"), F.explode(F.array(masked(F.col("m")))).alias("mask")).where("mask <> ''")


def clean(text: Column) -> Column:
    """Known tags off, common entities and curly quotes to plain characters."""
    x = F.when(text.contains("<"), F.regexp_replace(text, _TAGS, "\n")).otherwise(text)
    for entity, plain in ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return F.when(text.rlike("[^\n -~]"), F.translate(x, ODD, PLAIN)).otherwise(x)


def mark_slots(x: Column) -> Column:
    """Unfilled slots to one mark each."""
    x = F.regexp_replace(x, _any(STRONG_SLOT), SLOT)
    for hedged, sign in ((HEDGED_SLOT, SLOT), (BARE_SLOT, BARE)):
        for before, slot, after in hedged:
            x = F.regexp_replace(x, before + slot + after, f"$1{sign}$2")
    return x


def folded(x: Column) -> Column:
    """Non-ASCII runs to "_", spaces to one, digits to 0."""
    return F.trim(F.translate(F.regexp_replace(F.regexp_replace(x, r"[^\x00-\x7f]+", "_"), " {2,}", " "), "123456789", "000000000"))


def masked(x: Column) -> Column:
    """Folded text in lower case, names and ids with a capital inside, addresses, dates and numbers masked."""
    x = F.lower(F.regexp_replace(F.replace(x, F.lit("JavaScript"), F.lit("javascript")), ID_RE, "0"))
    for pattern, put in MASKS:
        x = F.regexp_replace(x, pattern, put)
    return F.trim(x)


def classify(mask: Column) -> Column:
    """struct(kind, grade) of a masked message, null where no rule holds."""
    words = F.size(F.split(mask, " "))
    latin = F.regexp_count(mask, F.lit(LATIN_RE))
    bare = F.regexp_replace(mask, QUOTED, " ")
    about, quotes = mask.rlike(ABOUT_RE), mask.contains('"')
    slot = (bare.contains(SLOT) | bare.contains(BARE)) & ~mask.rlike(SUBJECT)
    short = words <= NOTICE_WORDS
    script = short & mask.rlike(SCRIPT_RE) & mask.rlike(STATE_RE)

    def found(kind: str, grade: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(grade).alias("grade"))

    return (
        F.when((mask.rlike(LATIN_START) & (latin >= 4) & (latin >= 0.6 * words)) | repeats(mask, words), found("filler", 3))
        .when(slot, found("slot", 3))
        .when(bare.rlike(FIELD_RE) & ~about, found("field", 3))
        .when(mask.rlike(THIN_RE), found("field", 2))
        .when(about, None)
        .when(script & mask.rlike(ADDRESS_RE) & ~quotes, found("script", 2))
        .when(mask.rlike(ERROR_RE), found("error", 2))
        .when(mask.rlike(FILLER_RE) & short, found("filler", 2))
        .when(script & ~quotes, found("script", 1))
        .when(short & mask.rlike(FRAME_RE), found("frame", 0))
        .when((words <= TOPIC_WORDS) & ~quotes & mask.rlike(THING_RE) & mask.rlike(FAILURE_RE), found("error", 1))
    )


def repeats(mask: Column, words: Column) -> Column:
    """One to three words of letters again and again from the start of the message: at least nine words."""
    return (words >= 9) & mask.rlike(r"^((?:[a-z]+ ){1,3}?)\1\1")


def candidate_messages(docs: DataFrame) -> DataFrame:
    """doc_id, source, message (hash) and mask of messages with a word or sign that some rule
    needs, one row a document and message."""
    x = messages(spread(docs.select("doc_id", "text", "source")))
    x = x.withColumn("message", F.xxhash64("mask"))
    return x.groupBy("doc_id", "message").agg(F.min("source").alias("source"), F.min("mask").alias("mask"), F.count("*").alias("times"), F.sum("chars").alias("chars"), F.max("size").alias("size"))


def classified(candidates: DataFrame, min_docs: int = MIN_DOCS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """Masked messages grouped by hash: message, mask, kind, grade, n_docs, n_sources, recurs;
    those that no rule fits are left out.

    Documents are counted by source first, map side, so no message, however frequent, gathers
    its documents in one task. Each distinct message is classified once."""
    by_source = candidates.groupBy("message", "source").agg(F.count("*").alias("n"), F.min("mask").alias("mask"))
    whole = by_source.groupBy("message").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_sources"), F.min("mask").alias("mask"))
    whole = whole.withColumn("class", F.explode(F.array(classify(F.col("mask"))))).where("class IS NOT NULL")
    recurs = (F.col("n_docs") >= min_docs) & (F.col("n_sources") >= min_sources)
    return whole.select("message", "mask", "class.kind", "class.grade", "n_docs", "n_sources", recurs.alias("recurs"))


def residue_documents(docs: DataFrame, min_docs: int = MIN_DOCS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """doc_id, ``kinds``, ``grade`` (best of its messages) and ``by_recurrence`` (nothing but
    recurring messages speaks for it) of every document with residue.

    ``docs`` has doc_id, text, source. Null and blank texts are no case, nor are null ids;
    null sources count as one source; documents with the same id are one document. Extra
    columns are ignored.
    """
    candidates = cut_lineage(candidate_messages(docs))  # read twice: the texts are masked once
    rules = classified(candidates, min_docs, min_sources).select("message", "kind", "grade", "recurs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = candidates.select("doc_id", "message", "times", "chars", "size", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"))
    per_doc = own.join(rules, ["message", "salt"]).groupBy("doc_id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.max("grade").alias("grade"),
        F.count_if(F.col("grade") == 2).alias("wordings"),
        F.max(F.when(F.col("grade") == 2, F.col("times"))).alias("times"),
        F.count("*").alias("n"),
        (F.sum(F.when(F.col("kind") != "field", F.col("chars"))) >= F.max("size") / 2).alias("half"),
        F.bool_or(F.col("recurs") & (F.col("grade") > 0)).alias("recurs"),
    )
    alone = (F.col("grade") == 3) | ((F.col("wordings") >= 1) & ((F.col("n") >= 2) | (F.col("times") >= 2) | F.coalesce("half", F.lit(False))))
    return per_doc.where(alone | F.col("recurs")).select("doc_id", "kinds", "grade", (~alone).alias("by_recurrence"))
