"""Weak labels and contrast sentences for the classifier of template residue.

A weak label says what a sentence as a whole surely is.  A status line, a
notice, filler or a slot never filled gives 1 only if the sentence is that and
nothing more; a phrase inside a longer sentence, a bracket that logs use as
well, slots beside talk of slots or code: all these abstain.  Only sentences
without any such thing are labelled prose.  How phrases and marks look inside
prose is taught by the contrast sentences below, which are composed from frames.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick

# ---------------------------------------------------------------- segments

#: A sentence is judged in windows of so many characters, if it is longer.
WINDOW_CHARS = 600

_LINES = re.compile(r"[\r\n\u2028\u2029\x85]+")
_SENTENCES = re.compile(r"(?<=[^.!?。！？؟।][.!?。！？؟।])(?<![A-Z0][A-Z0][!?])(?:[\"'”’»)\]]*)(?:\s+|(?<=[。！？]))|(?<=[a-zà-ÿ]{2}[.!?])(?=[A-ZÀ-ÝÑ¿¡])")


def sentences(text: str) -> Iterator[str]:
    """Sentences of each line, a short line as one; long unbroken ones in windows that overlap by half."""
    for line in _LINES.split(text):
        for part in _SENTENCES.split(line) if len(line) > 40 else (line,):
            part = part.strip()
            if not part:
                continue
            if len(part) <= WINDOW_CHARS:
                yield part
            else:
                for at in range(0, len(part) - WINDOW_CHARS // 2, WINDOW_CHARS // 2):
                    yield part[at : at + WINDOW_CHARS]


# ------------------------------------------------------------ fixed values
# Ways of writing slots, status phrases, and the words of notices in several languages.

_NAME = r"[^\W\d](?:[\w.]|[ -](?=\w)){1,40}"
#: Slots that nothing else is written like.
CERTAIN_SLOTS = (
    rf"\{{\{{[-~#]?\s*{_NAME}\s*[-~]?\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"#\{{\s*{_NAME}\s*\}}", rf"\{{%-?\s*{_NAME}\s*-?%\}}", rf"<%[=-]?\s*{_NAME}\s*%>", rf"<<\s*{_NAME}\s*>>",
    rf"%\({_NAME}\)[sdf]", rf"(?<!\w)@{{1,2}}{_NAME}@{{1,2}}(?!\w)", rf"(?<![\w$\\]){'[$]'}{_NAME}{'[$]'}(?![\w$])", rf"(?<!\w)__{_NAME}__(?!\w)", rf"(?<![\w%])%{{1,2}}{_NAME}%{{1,2}}(?!\w)", rf"\{{\${_NAME}\}}",
    rf"(?<![\w*])\*\*\*{_NAME}\*\*\*(?![\w*])", rf"\{{\d+:{_NAME}\}}", rf"[\[(<«]{_NAME} (?:to be added|to follow|goes here|here|tbd|tba)[\])>»]", r"[\[<](?i:your|insert|enter|add)\b[^\[\]<>\n]{1,40}[\]>]",
    rf"\[\[\s*{_NAME}\s*\]\]", rf"(?<![\\{{}}\w$#%])\{{\s*{_NAME}\s*\}}(?!\}})", r"\[[A-Za-z]+(?:_[A-Za-z]+)+\]", r"\[[A-Z]+(?: [A-Z]+)+\]", rf"<[^\W\d]+_{_NAME}>",
)
#: Marks that slots share with logs, quotations, wikis and HTML.
OTHER_SLOTS = (rf"\[{_NAME}\]", rf"«\s*{_NAME}\s*»", rf"<{_NAME}>")
#: What programs print for a missing value.
_EMPTY = r"(?:\[object Object\]|#REF!|#N/A|#VALUE!|#NAME\?|undefined|null|NULL|None|NaN|nil|n/a|N/A|\(none\)|\?{3,}|X{3,})"
_BLANKS = r"_{4,}|\bX{3,}\b|\?{3,}|\.{6,}"
_TALK = r"\b(?:variables?|braces?|brackets?|templates?|slots?|syntax|shell|placeholders?|expands?|markup|tags?|macros?|fields?|prompts?|strings?|stands for|replaced by|substitut\w+)\b"
_CODE = r"[\\`]|:=|==|\(\)|;\s*$|\b(?:echo|printf|return|def|import|grep|sed|awk)\b"
_LOG = r"^\W{0,3}\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\b\w+=[\d.]+ \w+=[\d.]+"

_STATUS_PHRASE = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|length required|payload too large|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)"
_ERROR = r"(?:error|erreur|fehler|errore|erro|fout|fel|błąd|ошибка|エラー|错误|خطأ)"
_SCRIPTS = r"(?:\bjava ?script|javascript|\bjs\b|\bscripts?\b|\bscripting\b|скрипт\w*|スクリプト|脚本)"
#: Stems of verbs and states by which scripts are asked for.
_WANTED = r"(?:\benabl|activ|turn(?:ed)? (?:it )?o(?:n|ff)|switch(?:ed)? o(?:n|ff)|\ballow|\brequir|\bneed|\bdisabl|\bblock|\bsupport|\bwithout|aktivier|einschalt|eingeschaltet|erlaub|benötig|erforder|autoris|nécessit|requi|habilit|necesita|permit|abilit|attiv|richied|включ|разреш|отключ|有効|オン|启用|开启|打开|تفعيل|تمكين|schakel|inschakel|vereist|włącz)"
#: Who speaks in notices, at their beginning.
_SUBJECT = r"(?:(?:the|this|that|your|our|a|an)\s+)?(?:(?:requested|desired|web|database|current|internal)\s+)*(?:page|site|website|web ?page|resource|file|document|url|article|entry|content|server|service|app|application|connection|session|request|account|browser|link|gateway|address)"
_SUBJECT_ABROAD = r"(?:(?:die|der|das|diese[rs]?|la|le|l'|les|cette|cet|ce|el|los|esta|este|il|lo|questa|a|o|de|deze)\s*)?(?:(?:angeforderte|gewünschte|aktuelle)\s+)?(?:seite|dienst|server|datei|inhalt|artikel|anwendung|website|page|site|ressource|serveur|service|contenu|fichier|application|página|sitio|servidor|servicio|contenido|artículo|archivo|recurso|pagina|risorsa|servizio|serviço|conteúdo|страница|сервер|сайт|ページ|サーバー|页面|服务器|الصفحة|الخادم)"
_STATE = r"(?:(?:not|cannot|can't|couldn't|n't|never|no longer)\s+(?:be\s+|currently\s+)?(?:found|available|exists?|supported?|served|shown|displayed|loaded|located|reached|accessible|established|processed|completed|here|responding)|(?:isn't|aren't|doesn't|don't)\s+(?:here|available|found|exist|support|respond)|unavailable|expired|timed? out|is down|has moved|(?:is |been )?(?:blocked|denied|rejected|refused|suspended|forbidden)|under (?:construction|maintenance))"
_STATE_ABROAD = r"(?:nicht (?:\w+ )?(?:gefunden|verfügbar|erreichbar|vorhanden|geladen|angezeigt)|existiert nicht|introuvable|non trouvée?|n'existe (?:pas|plus)|indisponible|inaccessible|no (?:se )?(?:ha )?(?:sido )?(?:encontrad[ao]|encuentra|existe|disponible|responde)|non (?:trovat[ao]|esiste|disponibile)|não (?:encontrad[ao]|existe|disponível|responde)|niet (?:gevonden|beschikbaar)|не (?:найден\w*|существует|отвечает)|недоступ\w+|見つかりません|アクセスできません|不存在|找不到|无法访问|غير موجودة?|غير متاحة?)"
_ACCESS = r"(?:(?:access|permission) (?:denied|refused|forbidden)|zugriff (?:verweigert|nicht erlaubt)|kein zugriff|accès (?:refusé|interdit)|acceso (?:denegado|prohibido)|accesso negato|acesso negado|toegang geweigerd|доступ (?:запрещ\w+|закрыт)|アクセスが拒否|访问被拒绝|تم رفض الوصول)"
_NOTICES = (
    rf"{_SUBJECT}\b(?:\s+\S+){{0,6}}?\s*{_STATE}", rf"{_SUBJECT_ABROAD}\b(?:\s+\S+){{0,4}}?\s+{_STATE_ABROAD}", rf"{_STATE_ABROAD}\W*$", _ACCESS, r"(?:nothing|no (?:page|result|article|content|entry|match)s?)\s+(?:was |were |is |are )?(?:found|available)\b",
    r"(?:you|we) (?:do not|don't|are not|aren't|can't|cannot|can not|could not|couldn't|must|need to|have to) (?:\w+ )?(?:permission|authori[sz]ed|allowed|logged|sign|log|find|show|display|load|open|locate|process|complete)\b", r"(?:sie sind|vous (?:n'êtes|devez)|debe|usted no|no tiene|devi|você (?:não|precisa)) (?:\w+ ){0,3}(?:angemeldet|berechtigt|connecte\w*|autorisée?|iniciar|permiso|accedere|autorizad[ao]|entrar)",
    r"(?:an? )?(?:unexpected |unknown |internal |fatal |server )?(?:error|exception) (?:has )?(?:occurred|happened|was thrown)\b", r"something went wrong", r"(?:please )?try (?:it )?again\b(?: \w+){0,4}\W*$", r"(?:please )?(?:sign|log) ?in\b (?:again|to|or|with)\b", r"(?:please )?(?:verify|confirm|prove) (?:that )?you(?:'re| are) ", r"checking (?:your|the) (?:browser|connection)", r"(?:please )?(?:contact|notify|ask) (?:the|your|an?) (?:\w+ )?administrator", r"(?:please )?(?:reload|refresh) (?:the|this) page",
    r"(?:bitte )?versuchen sie es|(?:veuillez )?réessaye[rz]|inténtelo|(?:vuelva|intente) (?:a|de nuevo)|riprova|tente novamente|попробуйте", r"too many requests", r"rate limit(?: exceeded)?\W*$", r"(?:scheduled|planned) maintenance",
)
_FILLER_WORDS = r"(?:sample|dummy|placeholder|filler|example|test|blind|boilerplate)"
_FILLERS = (
    rf"(?:this (?:is|was) )?(?:just |only |some |an? |the )*{_FILLER_WORDS} (?:text|body|content|paragraph|copy|sentence|title|description)\b", r"(?:insert|enter|add|type|put|write) (?:\w+ ){0,2}(?:text|title|description|name|image|content|caption|line|paragraph|quote|date|headline|body)(?: here)?\W*$", r"your (?:\w+ ){0,2}(?:text|title|content|name|description|caption) (?:goes )?here",
    r"(?:more |new )?(?:content|text|description|article|page|details?)? ?(?:is )?(?:coming|to come|follows) ?soon", r"(?:tbd|tba|tbc|todo|fixme)\b", r"(?:\w+ )?to be (?:added|announced|completed|determined|written|replaced)\b",
    r"(?:ceci est |voici )?(?:un |du )?texte (?:de remplissage|provisoire|d'exemple|fictif|factice)", r"(?:dies|das|hier) (?:ist|steht|folgt|kommt) (?:\w+ ){0,4}(?:blindtext|platzhalter\w*|beispieltext|fülltext|inhalt|text)", r"(?:platzhalter|blindtext|beispieltext|fülltext)\w*\b", r"(?:aquí (?:va|irá)|próximamente|(?:este es |esto es )?(?:un )?(?:texto|contenido) (?:provisional|pendiente|de ejemplo|de relleno|ficticio))", r"(?:à compléter|contenu à venir|bientôt disponible)", r"testo (?:segnaposto|di esempio)|texto (?:de exemplo|provisório)|voorbeeldtekst|текст[- ](?:заполнитель|заглушка)|ダミーテキスト|示例文本|占位",
)
_PAGES = (rf"^<[^>]*>.{{0,80}}?\b(?:[45]\d\d\s+)?{_STATUS_PHRASE}", rf"^\{{.{{0,60}}?\"(?:error|status|code)\"\s*:\s*\{{?\s*(?:\"code\"\s*:\s*)?\"?[45]\d\d", r"^<noscript", r"^noscript\b")
#: Stems of the usual filler Latin, and the rows of keyboards.
_LATIN = tuple("lorem ipsum dolor amet consec adipis elit tempor incid pharet quisq morb maur tincid semper bland ultri lacin vitae nulla orci velit nimi nunc vehic pellent sodal suscip faucib fringil rhonc sagitt accums aliqu bibend commod condim conval curab dapib digniss eget eleif enim euis facilis felis ferment feug gravid habit hendr iacul imperd interd laor lect libero ligul lobor luct maecen magna malesu massa matti metus molest molli neque nibh nisi nisl odio ornar phasel placer porta portt posu praes preti proin pulvin purus quam risus rutr sapien sceler sociis sollic tellus tempus torto trist turpi ullam urna varius varum venen vestib vivam viver volut vulput sit sed vel".split())
_ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "qsdfghjklm", "zxcvbnm", "yxcvbnm")
_KEYS = frozenset(x[i:j][::d] for x in _ROWS for i in range(len(x)) for j in range(i + 3, len(x) + 1) for d in (1, -1))

# ------------------------------------------------------------- weak labels

#: The most words of a sentence that a phrase at its beginning may label.
NOTICE_WORDS = 16

_CERTAIN = re.compile("|".join(CERTAIN_SLOTS))
_OTHER = re.compile("|".join(OTHER_SLOTS))
_TALKING, _CODING, _LOGGED, _BLANK = re.compile(_TALK, re.I).search, re.compile(_CODE).search, re.compile(_LOG).search, re.compile(_BLANKS).search
_EMPTY_AT = re.compile(rf"(?:\b(?:by|of|to|in|at|from|near|on|with|and|for|see|dear|hat|von|de|en|par)\s+|[:|(«-]\s*){_EMPTY}(?!\w)|^{_EMPTY}\s+\w+", re.I)
_LABELLED = re.compile(rf"^[\w ]{{2,24}}:\s*{_EMPTY}\W*(?:\(.*\))?$")
_ANY_EMPTY = re.compile(rf"(?<!\w){_EMPTY}(?!\w)").search
_STATUS_LINE = re.compile(rf"^\W*(?:http(?:/\d(?:\.\d)?)?\s*)?(?:(?:status|{_ERROR}|code)\s*)*[:#]?\s*(?:[45]\d\d\b)?\W*{_STATUS_PHRASE}?\W*(?:\([^()]{{0,30}}\)\W*)?$", re.I).match
_STATUS_OPENING = re.compile(rf"^\W*(?:http\s+)?{_ERROR}\s*(?:code)?\s*[:#]?\s*[45]\d\d\b", re.I).match
_OPENING = re.compile("|".join(f"(?:{x})" for x in (*_NOTICES, *_FILLERS)), re.I).match
_INSIDE = re.compile("|".join((_ACCESS, r"\b(?:page|file) not found", _STATE_ABROAD, rf"[45]\d\d {_STATUS_PHRASE}", rf"\b{_FILLER_WORDS} text\b", r"\blorem ipsum\b")), re.I).search
_PAGE = re.compile("|".join(_PAGES), re.I).match
_SCRIPT, _WANT = re.compile(_SCRIPTS, re.I).search, re.compile(_WANTED, re.I).search
_SORRY = re.compile(r"^\W*(?:(?:we(?:'re| are) )?(?:sorry|oops|whoops|uh-oh|ups|entschuldigung|désolé|lo sentimos)\b\W*(?:but )?)*", re.I)
#: What happened once, and by whom, is told and not shown.
_TOLD = re.compile(r"\b(?:was|were|has been|had been|have been|wurde|fut|fue)\b.*\b(?:by|from|until|years?|since|von|par|por)\b", re.I).search
_APOLOGY = re.compile(r"^\W*(?:sorry|oops|whoops|uh-oh|ups|entschuldigung|désolé|lo sentimos)\W*$", re.I).match
#: A number that is neither a status nor part of a path.
_COUNTED = re.compile(r"(?<![/\w])(?![45]\d\d\b)\d[\d.,]*(?![/\w])").search
_QUOTE = re.compile(r"[\"“”„«»‚‘]").search
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[{}$<>@\[«%#_*|?=\\]|X{3}|\b(?:None|null|NULL|Null|NaN|undefined|nil|n/a|N/A)\b").search
#: Stems, in lower case, of which every notice, status line and filler has one; most sentences have none and are prose at once.
_STEMS = tuple(
    "script| js|js |lorem|placeholder|sample|dummy|blind|boilerplate|example text|test text|test content|beispiel|platzhalter|fülltext|remplissage|provis|exemple|ejemplo|relleno|segnaposto|esempio|voorbeeld|заполнитель|заглушка|ダミー|示例|占位|your |insert|enter |goes here|soon|tbd|tba|tbc|todo|fixme|to be |próximamente|compléter|à venir|hier |aquí|add |type |put |write |404|403|500|502|503|504|40|41|42|50|error|exception|erreur|fehler|erro|fout|ошибка|エラー|错误|خطأ|bad request|unauthori|payment|forbidden|not |n't |never |no longer|nothing|no page|no result|no article|no content|no entr|no match|conflict|gone|length req|payload|too many|rate limit|implemented|gateway|unavailable|timeout|time out|time-out|timed|expired|is down|has moved|blocked|denied|rejected|refused|suspended|maintenance|construction|access|permission|zugriff|accès|acceso|acesso|toegang|доступ|アクセス|访问|الوصول|nicht|existiert|introuvable|trouvé|existe|indisponible|inaccessible|disponible|responde|encontrad|encuentra|trovat|esiste|disponi|encontr|niet |найден|отвечает|недоступ|見つかり|できません|不存在|找不到|无法|موجود|متاح|must |need |have to|went wrong|again|sign in|signin|log in|login|verify|confirm|prove|checking|administrator|reload|refresh|versuchen|réessay|intént|intente|vuelva|riprova|tente |попробуйте|sie sind|vous |debe|usted|iniciar|conecte|connect|sorry|oops|whoops|uh-oh|ups|entschuldigung|désolé|lo siento|<html|<title|noscript|スクリプト|скрипт|脚本|javascript|request|content|inhalt|contenu|contenido".split("|")
)


def _automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w in words:
        out.add_word(w, 1)
    out.make_automaton()
    return out


_FIND_STEM = _automaton(_STEMS).iter


def triggered(part: str) -> bool:
    return next(_FIND_STEM(part.lower()), None) is not None


@lru_cache(maxsize=100_000)
def _fills(word: str) -> tuple[bool, bool]:
    """Whether a word is a piece of a keyboard's row, and whether it is filler Latin."""
    return word in _KEYS, word.startswith(_LATIN)


def filler(part: str) -> bool | None:
    """The same few words over and over, keys struck at random, or mostly filler Latin; None if a good part is that."""
    spaced = part.lower().split()
    if len(spaced) >= 6 and len(set(spaced)) * 4 <= len(spaced) and any(x.isalpha() for x in part):
        return True
    own = [w.lower() for w in _WORD.findall(part)]
    n = len(own)
    if n < 4 or len(spaced) < 4 or not own[0].isascii():
        return False
    share = max(map(sum, zip(*map(_fills, own)))) / n
    return True if share >= 0.5 else None if share >= 0.25 else False


def weak_label(part: str) -> int | None:
    """1 for what is surely a case as a whole, 0 for prose without any trace of one, None if unclear."""
    fill = filler(part)
    if fill:
        return 1
    marked, stemmed = _MARKS(part) is not None, triggered(part)
    if fill is False and not marked and not stemmed:
        return 0
    if _LOGGED(part):
        return 0 if not (_CERTAIN.search(part) or _ANY_EMPTY(part)) else None
    if _PAGE(part):
        return 1
    low = part.strip()
    words = len(low.split())
    if words <= 12 and any(x.isalnum() for x in low) and (_STATUS_LINE(low) or _STATUS_OPENING(low)) or _APOLOGY(low):
        return None if low.isdigit() or words == 1 and not low[0].isupper() else 1
    quoted = _QUOTE(low.strip("\"'«»“”„-–*#( ")) is not None
    bare = _SORRY.sub("", low).lstrip(" \t\"'«»*#-–—|:.([<")
    talking = marked and (_TALKING(part) is not None or _CODING(part) is not None)
    wants = _SCRIPT(part) is not None and _WANT(part) is not None
    if wants or _OPENING(bare):
        short = words <= NOTICE_WORDS and not quoted and not _COUNTED(low) or words <= 8
        # scripts may be spoken of in any sentence: only commands, browsers and states without a past tense are notices
        if wants and not _OPENING(bare):
            short = short and words <= 12 and not re.search(r"\b(?:was|were|had|that|who|which|its|he|she|they)\b|\w{4,}ed (?:scripts|javascript)", part, re.I)
        return 1 if short and not talking and not _TOLD(part) else None
    slots = _CERTAIN.search(part)
    if slots and not talking and not _QUOTE(_CERTAIN.sub("", low).strip("\"'«»“”„ ")):
        return 1
    empties = len(_EMPTY_AT.findall(part))
    if not talking and not slots and (_LABELLED.match(part) or empties >= 2):
        return 1
    if not talking and re.match(r"^(?:[\w ]{2,20}:\s*_{4,}\s*)+", part):
        return 1
    if slots or empties or _OTHER.search(part) or _BLANK(part) or _ANY_EMPTY(part) or fill is None or stemmed and _INSIDE(part):
        return None
    return 0


# --------------------------------------------------------------- contrast
# Invented sentences: the same notices, slots and values once by themselves and once inside prose about them.

NOTICES = (
    "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "HTTP error 405", "Error 410", "Bad Request", "Unauthorized", "Gateway Timeout", "Service Unavailable", "Page not found", "File not found", "Access denied", "Permission denied", "Something went wrong", "Please try again later", "An internal error has occurred",
    "The requested document could not be found", "This link is no longer available", "Your request was rejected", "You are not authorized to view this file", "Please log in to continue", "Please confirm you are human", "Too many requests", "Our service is down for planned maintenance", "Please contact your administrator", "Sorry, no page was found", "The connection was refused",
    "Please enable JavaScript", "JavaScript is required", "JavaScript is turned off in your browser", "This website requires JavaScript", "You must allow scripts to continue", "Your browser has scripts disabled", "Lorem ipsum dolor sit amet", "Placeholder text", "Sample paragraph", "Your headline goes here", "Text to be added", "More content coming soon", "Insert a caption here", "TBA",
    "Die angeforderte Seite wurde nicht gefunden", "Der Server ist nicht erreichbar", "Zugriff verweigert", "Fehler 404", "Bitte JavaScript einschalten", "JavaScript ist erforderlich", "Beispieltext", "Hier steht Blindtext, der später wegfällt", "Bitte melden Sie sich an",
    "Page introuvable", "Accès refusé", "Erreur 500", "Le serveur est indisponible", "JavaScript est requis", "Merci d'activer JavaScript", "Texte d'exemple", "Connectez-vous pour continuer",
    "Página no encontrada", "Acceso denegado", "Error 404", "El servicio no está disponible", "Se requiere JavaScript", "Habilite JavaScript", "Texto de ejemplo", "Inicie sesión para continuar",
    "Pagina non trovata", "Accesso negato", "Página não encontrada", "Acesso negado", "Страница не найдена", "Доступ запрещён", "Включите JavaScript", "ページが見つかりません", "JavaScriptを有効にしてください", "页面不存在", "请启用JavaScript", "الصفحة غير موجودة",
)
SPEECH = (
    "Our guide explains that \"{0}\" usually points to a wrong address.", "Most visitors who met “{0}” went back to the home page.", "The words '{0}' appeared on 12 of the 30 screens we tested.", "In her talk she showed why servers answer {0} and how to avoid it.", "The log of Monday counts {0} only twice, far below last year.", "Engineers treat {0} as a sign of load, wait a minute and send the call anew.",
    "He had painted {0} on the door as a joke, and it stayed there for years.", "Of 250 links, 31 led to {0} and were taken off the list.", "Historians of the web remember when {0} was the best known message of all.", "The survey asked readers how they feel about {0} on a small screen.", "If a client gets {0}, it keeps the old copy and reports nothing.",
    "Die Anzeige „{0}“ sahen nach Angaben des Betreibers nur wenige Kunden.", "Auf dem Schild am Bahnhof stand „{0}“, was viele belustigte.", "Le message « {0} » s'est affiché pendant deux heures, selon le journal.", "On lisait « {0} » sur l'écran de la gare, raconte un voyageur.", "El aviso «{0}» apareció en la pantalla del museo durante toda la tarde.", "Según el informe, muchos lectores vieron el texto «{0}» en 2019.",
    "Designers use {0} to see how a page looks before the writers are done.", "The crawler skips pages that say {0} because they carry no article.", "Pages with {0} were removed from the collection before it was printed.",
)
#: Prose in which the words of notices stand in their usual sense, marks do their usual work, and logs and code look as they do.
PROSE = (
    "The last letter of the captain was not found until a mason opened the wall in 1911.", "The missing key could not be found in either house.", "No other inn was available that night, and the guards denied them entry.", "The court was not available for comment.", "Her first request was rejected by the council in 1870.", "A page of the psalter was blocked from sale by the state.",
    "The service was held in the old chapel, and the server carried the candles.", "He could not open the gate because the lock was under repair.", "The script of the play was required reading in all schools.", "She turned the scripts over to the archive and kept no copy.", "Perl and JavaScript are both taught in the second term.", "JavaScript was chosen for the kiosk since its scripts run in any browser.", "They switched JavaScript off on the terminals in order to save power.",
    "The error of the survey was 404 feet, and the new map gives 500.", "Bus 404 stops at the market, and bus 502 goes on to the mill.", "Page 404 of the ledger lists 503 sacks of barley.", "Nobody named None or Null could register until the clerks repaired the form.", "A quarter of the sailors gave None as their faith, and 12 put Nil.", "Missing marks are kept as null, and averages over nothing become NaN.", "An undefined ratio is stored as NaN, and the job leaves out both.", "Null results are rarely printed, said the editor.",
    "Printers have filled specimen sheets with lorem ipsum since the sixties.", "Typesetters like lorem ipsum as dummy text since nobody stops to read it.", "Dummy text has been used to judge typefaces for five hundred years.", "The placeholder name Jane Doe was used in court.", "The sample text from the pond was read by two botanists.", "Wiki markup writes [[Target|label]] for a link, and browsers understand <b> or <em>.", "The export keeps tags such as <b>bold</b> or <ref name=\"a\"> and writes links as [[Leeds|city]].", "Editors put [sic] after the misspelling and [...] where they shortened the letter.", "The answer cites [2] and [7], but only [7] names the bridge.", "In his words, the [new] tower [...] was “a needle”.",
    "if (a < b && c > d) { return a[i] + b[j]; }", "rows = [x for x in items if x is not None]", "for (i = 0; i < n; i++) { total += v[i]; }", "SELECT name, count(*) FROM t WHERE x IS NOT NULL GROUP BY name;", "echo \"$HOME\" >> list.txt; for f in *.csv; do printf '%s\\n' \"${f}\"; done", "export PATH=\"$PATH:${HOME}/bin\"", "print(f\"{name}: {value}\")", "Choose {n | n < 9}, then |A| / 3 bounds the error.", "g(y) = \\frac{c}{d} + \\sqrt{7} is the mean of the sample.", "Let T = {y | y < 9} be the set of short items.", "It returns {\"ok\": true, \"rows\": 12} after each upload.", "The reply reads {\"id\": 7, \"score\": 0.25} and is stored as it came.", "| name | year | length |", "| Porto | 1911 | 37 |",
    "2023-01-05 10:12:44 [ERROR] worker=3 took_ms=12.5 retries=2", "2021-11-30T08:00:01 [INFO] rows=120 bytes=4096 skipped=0", "[WARN] 10:15:02 queue=7 wait_ms=88 dropped=0", "[DEBUG] cache=hit key=81 age=3.2", "INFO main: loaded 512 rows in 3.1 s", "ERROR worker 7: retry 2 of 5 after 30 s", "10.0.0.7 - - [05/Jan/2023:10:12:44] \"GET /a.html\" 404 153", "Remember the to-do list on the fridge: milk, bread and stamps.", "Their friend signed in at the hotel and logged every step.", "Try the soup again later in the year, when pumpkins are ripe.", "The site of the battle is under water and cannot be reached on foot.", "Das Buch wurde erst 1950 im Keller gefunden.", "Die Stelle war lange nicht verfügbar, da der Bach sie überschwemmte.", "Der Artikel nennt den Fehler von 404 Metern nicht.", "Le trésor reste introuvable depuis 1790.", "Le pont était indisponible pendant les travaux de 1822.", "El barco no fue encontrado hasta 1931.", "El camino no está disponible en invierno.", "Who found the lost ledger of the mill?", "Why was access to the harbour denied in 1870?", "Where did the server of the chapel live?",
)
_SLOT_FORMS = ("{{{{{}}}}}", "{{{{ {} }}}}", "${{{}}}", "#{{{}}}", "{{% {} %}}", "<%= {} %>", "<<{}>>", "[[{}]]", "%({})s", "@{}@", "@@{}@@", "${}$", "__{}__", "%%{}%%", "%{}%", "«{} goes here»", "({} to be added)", "[{} here]", "[insert {}]", "[insert {} here]", "<insert {}>", "<your {}>", "<{}>", "{{{}}}", "***{}***", "{{0:{}}}", "[YOUR {}]", "[{}]")
_SLOT_NAMES = ("customer", "last_name", "order id", "STREET", "PRICE_EUR", "nombre", "adresse", "PAGE TITLE", "stadt", "amount")
_SLOT_CASES = (
    "{0} lives in {1}.", "{0} moved to {1} and opened a bakery there.", "Query: {0}", "{0}", "Parcels for {0} leave from {1} before noon.", "Hello {0}, we received your form of {1}.", "The bakery of {0} was sold in {1}.", "[3] {0}", "Jan Novak ({0}, {1}) painted the quay at {0}.", "{0} liegt in {1} und gehört {0}.", "{0} vive en {1} desde 1990.", "{0} habite à {1}, près de {0}.", "Changed by {0}, {1}", "Name: {0}  Street: ______", "Wages in {1} were paid by Jan Novak; see {0}.",
)
_SLOT_TALK = (
    "In this language {0} is a variable, and {1} is another.", "Write {0} wherever the mail should greet somebody, the handbook advises.", "The macro takes the arguments {0} and {1}, which the printer fills in at each use.", "A form letter has the fields {0} and {1}; the mailer replaces both of them.", "Vue puts a variable into double braces, as in {0}, whereas Bash writes {1}.", "The shell expands {0} to the home folder, and {1} is empty.", "The old blanks with {0} were completed by hand by the clerks in 1870.", "The prompt has a slot {0}, filled with the question before it is sent.", "Of the slots, {0} and {1}, the shop fills only the first before printing.", "In templates, {0} stands for the buyer and {1} for the town.", "The syntax {0} marks a placeholder, said the lecturer.", "A script reads {0} from the folder of the job, and {1} is not used.", "Brackets such as {0} mean a blank that clerks fill in.",
)
_EMPTIES = ("[object Object]", "#REF!", "#N/A", "undefined", "null", "NULL", "None", "NaN", "nil", "n/a", "????", "XXXX")
_EMPTY_CASES = ("Heading: {0}", "{0} | {1} | {0}", "Our {0} in {1} was opened by {0} and seats {1} guests.", "Greetings from {0}, gate to {1} and {0}!", "Reply: {0} (compare {1}, sheet {0})", "{0} grew up in {1} and taught {0} at {1}.", "Origin: {0}", "Excerpt: {0}", "Greetings from {0}, gate to Porto and {1}!", "{0} grew up in Porto in 1931 and taught {1} at {0}.", "Written by {0} | {1} | {0} comments", "At {0} the quay of {1} sold {0} boats.")
_REAL = ("Maria Silva", "Porto", "a red barn", "who owns the red barn?", "1931", "theory of colour", "why did the ferry to Porto stop?", "Jan Novak, Turku", "27", "which school did Maria Silva visit?", "how many bakers live in Porto?", "a small quay of Turku", "what is sold at the quay?")


def contrast() -> tuple[list[str], list[str]]:
    """(prose, cases): notices alone and spoken of; slots unfilled, filled and spoken of; values missing and given."""
    slots = [f.format(n) for n in _SLOT_NAMES for f in _SLOT_FORMS]
    pairs = list(zip(slots, slots[7:] + slots[:7]))
    cases = [y for x in NOTICES for y in (x, x + ".", x.upper(), "<noscript>" + x + "</noscript>" if _SCRIPT(x) else x + "!")]
    cases += [f.format(*pairs[(i * 37 + j) % len(pairs)]) for i, f in enumerate(_SLOT_CASES) for j in range(60)]
    cases += [f.format(e, e) for e in _EMPTIES for f in _EMPTY_CASES]
    cases += [" ".join((x,) * n) for x in ("title", "name", "Story", "more", "abc", "news", "xx", "hey") for n in (7, 12, 30, 80)]
    keys, latin = sorted(x for x in _KEYS if len(x) in (3, 4)), [x for x in _LATIN if len(x) > 3]
    cases += [" ".join(own[(i * 31 + j * 17 + i * j) % len(own)] for j in range(5 + i % 12)).capitalize() + "." * (i % 2) for own in (keys, latin) for i in range(40)]
    prose = [f.format(x) if j % 4 else f.format(x).upper() for i, f in enumerate(SPEECH) for j, x in enumerate(NOTICES[i % 3 :: 3])]
    prose += [f.format(*pairs[(i * 41 + j) % len(pairs)]) for i, f in enumerate(_SLOT_TALK) for j in range(60)]
    prose += [f.format(a, b) for f in (*_SLOT_CASES, *_EMPTY_CASES) for a in _REAL for b in _REAL[:3] if a != b]
    words = [x.split() for x in PROSE]
    pieces = [" ".join(w[a : a + n]) for w in words for a, n in ((0, 2), (0, 4), (len(w) // 2, 3), (len(w) // 2, 30), (0, 1)) if len(w) > a + 4]
    prose += [*PROSE * 3, *pieces, *(x.upper() for x in (*PROSE, *pieces))]
    return prose, cases
