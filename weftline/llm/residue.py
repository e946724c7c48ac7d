"""Template residue and error-page text (problem 10): unfilled placeholders, filler, messages instead of content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

# Placeholder grammars, one for each kind of delimiter. A name is one to four words, joined by blanks, dots, dashes or
# underscores; what stands between the delimiters must look like a name, not like code, prose or a citation.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ ._-][A-Za-z0-9]+){0,3}"
_ANY = r"[^\W\d_][\w]*(?:[ ._'-]\w+){0,3}"  # in any script, where the delimiter itself is a sign
GRAMMARS = {
    "double braces": r"\{\{\{?[#/^&>]?\s*" + _ANY + r"(?:\s*(?:\||:|\?\?)[^{}\n]*)?\s*\}\}",
    "percent braces": r"\{%-?\s*" + _ANY + r"\s*-?%\}",
    "dollar braces": r"\$!?\{\s*" + _ANY + r"(?:\s*[:?|][^{}\n]*)?\s*\}",
    "hash braces": r"#\{\s*" + _ANY + r"\s*\}",
    "at or bang braces": r"@\{\s*" + _ANY + r"\s*\}|\{!\s*" + _ANY + r"\s*\}",
    "double brackets": r"\[\[\s*" + _NAME + r"\s*\]\]",
    "bracket signs": r"\[%\s*" + _ANY + r"\s*%\]|\[\$\s*" + _ANY + r"\s*\]",
    "angle percent": r"<%[=#-]?\s*" + _ANY + r"\s*-?%>|<\?(?:=|php echo)\s*\$?" + _ANY + r"\s*;?\s*\?>",
    "double angles": r"<<\s*" + _ANY + r"\s*>>|«\s*[A-Za-z]\w*(?:[._]\w+|[A-Z]\w*)+\s*»|«[A-Z][A-Z0-9_]*»",
    "merge bars": r"\*\|\s*[A-Z][A-Z0-9_:.]*\s*\|\*|\|\|\s*[A-Za-z][\w.]*\s*\|\||~~[A-Z][A-Z0-9_]*~~",
    "insert here": r"\[(?i:insert|your|enter|add|type|put|fill in|replace with|choose|select|company|customer|client|recipient|first|last|full) [^\[\]\n]{1,80}\]|<(?i:insert|your|enter|add|type|put|fill in) [^<>\n]{1,80}>|\((?i:insert|enter|add|type|fill in) [^()\n]{1,80} here\)|<" + _NAME + r" here>|\[" + _NAME + r" here\]",
    "insert here, other languages": r"\[(?i:ihr|ihre|ihren|hier|bitte|votre|vos|insérer|insérez|saisir|su|sus|tu|insertar|inserte|escriba|vostro|vostra|inserire|inserisci|seu|sua|inserir|insira|uw|vul|voer|ваш|ваша|ваше|введите|вставьте|укажите)(?: [^\[\]\n]{1,80})\]|［[^［］\n]{1,40}］|【(?:[^【】\n]{0,30}(?:入力|記入|挿入|お名前|氏名|会社名|日付|ここ)[^【】\n]{0,30})】|〇{2,}|○{2,}",
    "names in brackets": r"\[(?i:name|first name|last name|full name|company|company name|date|day|month|year|city|address|email|e-mail|phone|title|subject|product|product name|price|amount|number|url|link|website|image|logo|location|time|event|description|text|content)\]|<(?i:name|first name|last name|full name|company|company name|date|city|address|email|phone|product name|price|amount)>",
    "capitals in brackets": r"\[[A-Z][A-Z0-9]*(?:[ _.-][A-Z0-9]+){0,3}\]",
    "percent signs": r"%[A-Z][A-Z0-9]*(?:[_.][A-Z0-9]+){0,3}%|%%\s*" + _ANY + r"\s*%%|%\([A-Za-z_]\w*\)[sd]",
    "underscores": r"__[A-Z][A-Z0-9]*(?:[_.][A-Z0-9]+){0,3}__",
    "at signs": r"@@[A-Za-z][A-Za-z0-9_.]*@@",
    "dollar signs": r"\$\$?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+\$?\$?|\$\$?[A-Z][A-Z0-9_]*\$\$?",
    "hash signs": r"##?[A-Z][A-Z0-9_]*##?(?![\w-])|#(?:REF|VALUE|DIV/0|NAME|N/A|NULL)[!?]?",
    "number in braces": r"(?<![\w$\\}])\{\d{1,2}\}",
    "name in braces": r"(?<![\w$\\#{%@])\{[A-Za-z][A-Za-z0-9]+(?:[._-][A-Za-z0-9]+){0,3}\}(?!\})",
    "format directive": r"(?<![\w%])%(?:\d+\$)?[sd]\b",
    "printed nothing": r"\[object Object\]|(?<![\w'\"`(.])undefined(?![\w'\"`)(])|\b(?:NaN|null|None) (?:of|out of|in|and) (?:NaN|null|None)\b|\b(?:Dear|Hello|Hi|Hallo|Bonjour|Hola|Ciao|Olá|Beste) (?:null|None|NaN|nil)\b",
}
_PLACEHOLDER = re.compile("|".join(f"(?:{g})" for g in GRAMMARS.values()))

# What a text around a single mark says when it explains the mark instead of leaving it unfilled.
_EXPLAINS = re.compile(
    r"stands? for|mark like|such as|for example|e\.g\.|expands?|syntax|placeholder|template (?:file|engine|language)|you (?:write|type|put)|is replaced (?:by|with)|\bmanual\b|variables?\b",
    re.I,
)
_FENCE = re.compile(r"^(```|~~~).*?^\1[^\n]*$", re.S | re.M)
_INLINE_CODE = re.compile(r"`[^`\n]+`")
_CODE_LINE = re.compile(
    r"""^(?:\s{4,}\S.*
        |\s*(?:def|class|return|import|from|function|var|let|const|if|for|while|else|elif|try|except|print|public|private|static|void|int|echo|export|sudo|git|curl|pip|npm)\b.*[(){};:=\[\]].*
        |\s*(?:SELECT|FROM|WHERE|GROUP\ BY|ORDER\ BY|INSERT\ INTO|UPDATE|DELETE)\b.*
        |\s*</?[A-Za-z][\w-]*(?:\s[^<>]*)?>.*
        |\s*\\(?:newcommand|begin|end|def|usepackage)\b.*
        |\s*-\ \w+:\s.*|\s*[\w-]+:\s*
        |\s*\w+\s*=\s*\S.*|.*[;{}]\s*
        |\s*\#\s.*|\s*[*-]\ \[?\w+\]?(?:\([^)]*\))?\s*
        |\s*[$>]\s\w.*)$""",
    re.X,
)


def without_code(text: str) -> str:
    """The text without fenced blocks, inline code and paragraphs whose lines are mostly code."""
    text = _INLINE_CODE.sub(" ", _FENCE.sub("\n\n", text))
    kept = []
    for para in re.split(r"\n[ \t]*\n", text):
        lines = [x for x in para.split("\n") if x.strip()]
        if len(lines) > 1 and 2 * sum(bool(_CODE_LINE.match(x)) for x in lines) > len(lines):
            continue
        kept.append(para)
    return "\n\n".join(kept)


# Messages that stand where content should be, by what they say. Each is matched inside one sentence.
_SCRIPT = r"(?:java ?script|\bjs\b|(?:client-side )?scripting|scripts\b|active content|skripte?n?\b|スクリプト|скрипт\w*)"
_ENABLE = r"(?:enabl\w+|activ\w+|aktivier\w+|attiv\w+|abilit\w+|allow\w*|permit\w*|turn\w* (?:it )?on|switch\w* (?:it )?on|requir\w*|needs?\b|unblock|habilit\w+|ative\b|включ\w+|разреш\w+|eingeschaltet\w*|einschalten|inschakelen|schakel\w*|zet\b|有効|許可)"
_DISABLED = r"(?:disabl\w+|switched off|turned off|blocked|not support\w*|deaktivier\w*|ausgeschaltet|désactiv\w+|desactivad\w*|desativad\w*|disabilitat\w*|отключ\w+|uitgeschakeld|無効)"
MESSAGES = {
    "scripts": f"{_ENABLE}.{{0,60}}{_SCRIPT}|{_SCRIPT}.{{0,60}}(?:{_ENABLE}|{_DISABLED})|(?:turn|switch) it on (?:in your browser|and (?:refresh|reload))|some parts of this site will not work|(?:enable|allow|accept) cookies",
    "not found": r"\b(?:the|this|that) \w+ (?:you (?:asked for|requested) )?(?:has been (?:deleted|removed|moved)|was (?:deleted|removed|moved)|no longer exists|has expired|is gone|is not available|could not be (?:found|loaded|shown)|cannot be (?:found|loaded|shown)|does not exist|failed to load)\b|\bhttp [45]\d\d\b|\b(?:page|address|listing|link|document|file|url|item|article|product)\b.{0,60}\b(?:not (?:be )?found|no longer exists?|does not exist|removed|moved|never existed|cannot be shown|has expired|is gone|not available|unavailable)|nothing lives at this address|page not found|page introuvable|(?:page|adresse) (?:demandée )?(?:est )?introuvable|seite (?:wurde )?nicht gefunden|link ist (?:veraltet|falsch)|(?:no se ha encontrado|no se encontró) la página|página no encontrada|página não encontrada|pagina non trovata|collegamento non è più valido|pagina niet gevonden|страница не найдена|ページが見つかりません",
    "check address": r"vérifiez l'adresse|compruebe la dirección|verifique o endereço|controleer het adres|проверьте адрес|アドレスをご確認|check the (?:address|url|link)",
    "server": r"\b(?:error|fehler|erreur) \d{3}\b|\b[45]\d\d\b ?(?:-|:|–)? ?(?:the page|bad gateway|service|forbidden|not found|internal|gateway|unauthori[sz]ed|too many|unavailable)|something went wrong|internal server error|erreur interne|ein fehler ist aufgetreten|laden sie die seite neu|timed out|time-?out|bad gateway|service (?:temporarily )?unavailable|temporarily unavailable|could not connect|cannot connect|connection was (?:closed|reset|refused)|is being serviced|down for maintenance|under maintenance|failed to load|could not be loaded|try again (?:later|in)|réessayer plus tard|wartungsarbeiten|en mantenimiento|certificate of this host|upstream host",
    "stack trace": r"traceback \(most recent call last\)|(?:exception at |error: ?')|fatal error:|stack trace:|warning: could not",
    "refused": r"access (?:denied|for the user was refused)|\bforbidden\b|(?:lack|have no|do not have) (?:the )?permission|you are not (?:allowed|authori[sz]ed)|address was blocked|too many requests|slow down and come back|session has expired|sign in again|log ?in (?:again )?to (?:continue|go on)|not available in your (?:region|country)|zugriff verweigert|accès (?:refusé|interdit)|acceso denegado|acesso negado|accesso negato|доступ запрещ|toegang geweigerd|アクセスが拒否",
    "empty result": r"no (?:results?|matches|items?|entries|records?)\b.{0,40}(?:found|match\w*|for|to show|available)|nothing (?:was )?found|try (?:other|different) (?:words|terms|keywords)|0 results|keine (?:ergebnisse|treffer)|aucun résultat|sin resultados|nessun risultato|nenhum resultado|geen resultaten|ничего не найдено|見つかりませんでした",
    "waiting": r"^\W*(?:please wait|loading|coming soon|one moment|bitte warten|patientez|espere|attendere|aguarde|подождите|even geduld|お待ちください|under construction)\b.{0,20}$|please wait|checking (?:that you are not a robot|your browser)|you are (?:not )?a robot|this takes a few seconds",
}
FILLER = {
    "latin": r"\blorem\b|\bipsum\b|dolor sit amet",
    "stand-in": r"(?:dummy|sample|placeholder|filler) (?:copy|text)|replace (?:it|this) before launch|your (?:content|text) here|text goes here|click here to (?:add|edit)|double click to edit|edit me\b|this is a paragraph\W*$|body copy|^\W*(?:headline (?:one|two|\d)|subline|header here)\W*$|describe what you do|todo: ?write|\btbd\b|item name ?/ ?item description|blindtext|hier steht bald|texte de remplacement|faux[- ]texte|texto de (?:ejemplo|relleno|exemplo)|testo (?:di esempio|segnaposto)|voorbeeldtekst|текст-заполнитель|ダミーテキスト|サンプルテキスト",
    "keys": r"^\W*(?:(?:asdf|qwer|jkl|x{3,}|test|foo|bar|blah|abc|z{3,}|a{3,})(?:[\W\d]+|$)){2,}$",
}
# What stands around such messages and is no content either.
_CHROME = re.compile(
    r"\b(?:(?:incident|ticket|request|reference|error)(?: (?:number|code|id))?\W{0,3}[a-z]?\d[\w-]*|nginx|apache|cloudflare|retry|yes ?/ ?no|was this helpful|sorry about that|oops|go back to the front page|return home(?: ?\| ?contact)?|here is how|if this goes on, write to the webmaster|contact the webmaster)\b",
    re.I,
)
_BAR = re.compile(r"^[^|]{1,40}(?: \| [^|]{1,40}){1,12}$")
_MESSAGE = re.compile("|".join(f"(?:{m})" for m in MESSAGES.values()), re.I)
_FILLER = re.compile("|".join(f"(?:{m})" for m in FILLER.values()), re.I)
# A message inside quotes is quoted, and one that is told about is told about.
_TOLD = re.compile(r"\b(?:recalls?|was all the screen showed|the authors|which is why|visitors|readers?|explains? what|a site that|so the)\b|^[\"“„«]", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힯]")
# Made-up Latin: sentences in which words of the usual filler stems are dense.
_LATIN_WORD = re.compile(r"\b(?:lorem|ipsum|ipsam|dolor\w*|amet|elit|magn(?:a|is)|tempora?|labor[ae]|minima?|animus|amor|velit\w*|aliqua\w*|consect\w*|exert?\w*|deserun\w*|pariat\w*|nisi\w*|sint\w*|novera|culpat?|mollit|ullam\w*|quis\w*|vendis|vestis|estor|occae\w*|comoda|fugi\w*|cupid\w*|irur\w*|repreh\w*|cill\w*)\b", re.I)


# Words that some sentence of each language can hardly do without, and endings of Latin: a text of some length with none of
# the former and many of the latter is made-up Latin, whatever its words.
_FUNCTION = frozenset(
    "the of and to in is that for it as with on by this are be at from or was an der die das und ist nicht ein eine mit von zu den im auf für le la les des et est un une que qui dans pour pas sur el los las de y en es una con por se del lo il di e che per non sono gli della o os as do da em um uma com não para het een van en op te dat niet voor we you i he she they has have had will can our your my".split()
) - frozenset("in et e o a est is non".split())
_LATIN_END = re.compile(r"(?:us|um|am|em|is|at|ae|ur|nt|que|bus|rum|esse|tio)$")
_ASCII_WORD = re.compile(r"[a-z]+")


def is_made_up_latin(sentence: str) -> bool:
    """Latin, or what imitates it: no word is a function word of the languages around, and at least two fifths of six words
    or more, or nearly all of three to five long ones, have an ending of Latin."""
    words = _ASCII_WORD.findall(sentence.lower()) if sentence.isascii() else []
    if len(words) < 3 or any(w in _FUNCTION for w in words):
        return False
    latin = sum(_LATIN_END.search(w) is not None for w in words)
    return 5 * latin >= (2 if len(words) > 5 else 4) * len(words) and (len(words) > 5 or sum(map(len, words)) >= 8 * len(words))


def _size(s: str) -> int:
    """Characters but blanks, a character of a script without blanks counting three times."""
    return len(s) - s.count(" ") + (0 if s.isascii() else 2 * len(_CJK.findall(s)))


# A grammar of messages. What a site says instead of content names a thing of the web and what is wrong with it: a word
# of failure, or a denial together with finding, being there or being allowed; or it asks the reader for something only
# such messages ask for. Words are stems from their beginning; "$" ends a whole word, and "*" stands before what may be the end of one. Forms of verbs that have a person
# as subject are left out: people who find no page are told about, a page that is not found is a message.
_T, _N, _V, _F, _A, _SCRIPTS, _ENABLING = 8, 16, 32, 64, 128, 256, 512
WORDS = {
    "en": (
        "page, site, website, web site, url, link, address$, file, document, article, post$, posts$, item, product, listing, entry, record, resource, content, video, image, photo, account, profile, session, request, service, server, host$, gateway, connection, network, database, application, app$, feature, form$, search, query, result, browser, access, permission, password, login, token, certificate, region, country, domain, store$, shop$, offer, auction, thread, topic, forum, user, member, subscription, cart$, basket, order, category, collection, playlist, channel, player, plugin, system, operation, transaction, process$, job$, vacancy, event, ticket, map$, comment, review, message, feed, stream, download, upload, module, section",
        "not$, no$, 't$, ’t$, lack$, lacks$, cannot, never, unable, without, neither, none$, nothing, zero$, 0$",
        "found, available, exist$, exists$, existed$, reached, reachable, accessible, accessed, loaded, load$, opened, displayed, display$, shown, processed, process$, completed, retriev, permitted, allowed, authori, connected, matched, match$, supported, valid$, recogni, resolved, located, verified, enabled, lives at, permission to, results$, looking for, work$, function$",
        "unavailable, unreachable, inaccessible, expired, removed$, deleted$, suspended, deactivated, terminated, disabled, forbidden, denied, refused, rejected, restricted, blocked, banned, prohibited, unauthori, timed out, time out, timeout, failed, failure, error, exception, crashed, aborted, went wrong, gone wrong, maintenance, overload, exceeded, too many, offline, is down$, out of stock, sold out, discontinued, invalid, malformed, missing$, is gone, has gone, has moved, have moved, been moved, is private, are private, bad gateway, internal server, outdated, mistyped, misspelled, misspelt, is broken, taken down, been archived, under construction, temporarily, no longer, unexpected, bad request, not found, is empty, are empty, not connect, unable to connect, t connect, not respond, run out$, fatal error, traceback, stack trace",
        "try again, try later, try refreshing, try reloading, try another, try a different, try other, refresh the, refresh this, refresh your, reload, go back to the home, go back to the front, go back to the previous, return to the home, return to the front, return to the previous, back to home, back to the home, homepage, contact support, contact us, contact the admin, contact the site, contact your, contact our, contact customer, log in to, sign in to, log in again, please log, please sign, subscribe to continue, subscribe to read, check the url, check the address, check the spelling, check your connection, check your internet, check your spelling, check back, come back later, come back soon, be back soon, be back shortly, back online, search again, start over, clear your, broaden your, fewer filters, remove some filters, different keywords, fewer keywords, please wait, hold on, stand by, in a moment, just a moment, one moment, redirected, redirecting, loading, verifying, verify you are, verify that you, are human, not a robot, captcha, please enable, enable cookies, enable javascript, upgrade your browser, update your browser, unsupported browser, disable your ad, ad blocker, adblock, coming soon, stay tuned, watch this space, traceback, stack trace, fatal error, *exception at, *exception in, sign in again, a few seconds, a few moments, switch it on, turn it on, and refresh, refresh to, and reload",
    ),
    "de": (
        "seite, webseite, website, adresse, link, datei, dokument, artikel, beitrag, inhalt, produkt, angebot, anzeige, eintrag, bild$, video, konto, sitzung, anfrage, dienst$, server, verbindung, zugriff, zugang, berechtigung, suche, suchbegriff, suchanfrage, ergebnis, treffer, browser, anwendung, datenbank, nutzer, benutzer, shop$, warenkorb, veranstaltung, stelle$",
        "nicht$, kein, nie$, null$, weder, leider",
        "gefunden, verfügbar, erreichbar, existiert, vorhanden, geladen, geöffnet, angezeigt, erlaubt, gestattet, berechtigt, zugelassen, verarbeitet, hergestellt, abgerufen, nicht unterstützt, gültig, zugänglich, freigegeben, online, suchergebnis, treffer",
        "gelöscht, entfernt, verschoben, gesperrt, abgelaufen, fehlgeschlagen, fehler, verweigert, verboten, untersagt, überlastet, wartung, vorübergehend, zeitüberschreitung, ungültig, schiefgelaufen, schief gelaufen, deaktiviert, unterbrochen, ausverkauft, nicht mehr, offline, zu viele, störung, existiert nicht, veraltet, falsch geschrieben, falsch eingegeben, vertippt",
        "versuchen sie es, versuche es, später erneut, später noch, noch einmal, laden sie, lade die, neu laden, melden sie sich, bitte anmelden, zurück zur, zur startseite, kontaktieren sie, wenden sie sich, überprüfen sie, prüfen sie, bitte warten, einen moment, einen augenblick, wird geladen, werden geladen, in kürze, demnächst, bald wieder, sind bald, bitte aktivieren, aktivieren sie, weitergeleitet, kein roboter, ein mensch",
    ),
    "fr": (
        "page, site$, adresse, lien, fichier, document, article, contenu, produit, offre, annonce, image, vidéo, compte, session, requête, demande, service, serveur, connexion, accès, autorisation, recherche, résultat, navigateur, application, base de données, utilisateur, boutique, panier, ressource, événement",
        "pas$, plus$, aucun, jamais, impossible, rien$",
        "trouvé, disponible, accessible, existe, autorisé, permis, valide, chargé, affich, traité, correspond, joignable, pris en charge, afficher, charger, établi",
        "introuvable, supprimé, déplacé, retiré, expiré, échoué, échec, erreur, refusé, interdit, bloqué, suspendu, désactivé, indisponible, inaccessible, maintenance, surcharg, délai dépassé, invalide, temporairement, épuisé, en construction, hors ligne, trop de, n'existe plus, panne",
        "réessay, essayez, actualis, recharg, rechargez, revenez, retour à l'accueil, page d'accueil, contactez, connectez-vous, identifiez-vous, vérifiez, veuillez, patientez, un instant, chargement, bientôt, en cours de, redirig, pas un robot, activez",
    ),
    "es": (
        "página, sitio, dirección, enlace, archivo, documento, artículo, contenido, producto, oferta, anuncio, imagen, vídeo, video, cuenta, sesión, solicitud, petición, servicio, servidor, conexión, acceso, permiso, búsqueda, resultado, coincidencia, navegador, aplicación, base de datos, usuario, tienda, carrito, recurso, evento",
        "no$, ningún, ninguna, nunca, nada$, lamentablemente, imposible",
        "encontrad, se encontr, se encuentr, disponible, existe, accesible, permitid, autorizad, válid, cargad, cargar, mostrar, procesar, hay$, conectar, se ha podido, se pudo, compatible",
        "eliminad, borrad, movid, retirad, caducad, expirad, expiró, ha fallado, fallo, falló, error, denegad, prohibid, bloquead, suspendid, desactivad, deshabilitad, mantenimiento, sobrecarg, tiempo de espera, inválid, temporalmente, agotad, en construcción, fuera de servicio, fuera de línea, demasiad, ya no, salió mal, salido mal",
        "inténtelo, inténtalo, intente de nuevo, intente nuevamente, vuelva a, vuelve a intentar, actualice, recargue, regrese, volver al inicio, página de inicio, póngase en contacto, contacte, inicie sesión, inicia sesión, compruebe, verifique, espere, un momento, cargando, próximamente, muy pronto, redirigi, no es un robot, no eres un robot, active$, habilite, pruebe con, prueba con",
    ),
    "it": (
        "pagina, sito, indirizzo, link, collegamento, file, documento, articolo, contenuto, prodotto, offerta, annuncio, immagine, video, account, sessione, richiesta, servizio, server, connessione, accesso, permesso, autorizzazione, ricerca, risultat, browser, applicazione, database, utente, negozio, carrello, risorsa, evento",
        "non$, nessun, mai$, niente, nulla$, impossibile, purtroppo",
        "trovat, disponibil, esiste, accessibil, consentit, permess, autorizzat, valid, caricat, caricare, mostrare, visualizzare, elaborat, raggiungibil, supportat",
        "eliminat, rimoss, spostat, cancellat, scadut, fallit, errore, negat, vietat, bloccat, sospes, disattivat, disabilitat, indisponibil, manutenzione, sovraccaric, tempo scaduto, temporaneamente, esaurit, in costruzione, fuori servizio, troppe, troppi, non più, andato storto",
        "riprova, si prega di, ricarica, aggiorna la, torna alla, torna indietro, pagina iniziale, contatta, accedi$, effettua l'accesso, verifica l, verifica che, verifica di, controlla l'indirizzo, controlla la connessione, attendere, attendi, un momento, caricamento, prossimamente, presto online, reindirizz, non sei un robot, attiva$, attivare, abilita, prova con",
    ),
    "pt": (
        "página, site$, sítio, endereço, link, ligação, arquivo, ficheiro, documento, artigo, conteúdo, produto, oferta, anúncio, imagem, vídeo, conta$, sessão, solicitação, pedido, requisição, serviço, servidor, conexão, acesso, permissão, pesquisa, busca$, resultado, navegador, aplicação, aplicativo, banco de dados, usuário, utilizador, loja$, carrinho, recurso, evento",
        "não$, nenhum, nunca, nada$, impossível, infelizmente",
        "encontrad, disponível, existe, acessível, permitid, autorizad, válid, carregad, carregar, exibir, mostrar, processar, foi possível, compatível, há$",
        "removid, excluíd, eliminad, apagad, movid, expirad, expirou, falhou, falha, erro$, erros$, negad, proibid, bloquead, suspens, desativad, indisponível, manutenção, sobrecarreg, tempo esgotado, inválid, temporariamente, esgotad, em construção, fora do ar, fora de serviço, demasiad, deu errado, correu mal, já não",
        "tente novamente, tente de novo, tente mais tarde, atualize, recarregue, volte, voltar ao início, página inicial, contacte, entre em contato, contate, faça login, inicie sessão, verifique, aguarde, um momento, carregando, a carregar, em breve, redirecion, não é um robô, ative$, habilite, tente outr",
    ),
    "nl": (
        "pagina, site$, website, adres, link, koppeling, bestand, document, artikel, inhoud, product, aanbieding, advertentie, afbeelding, video, account, sessie, verzoek, aanvraag, dienst$, server, verbinding, toegang, toestemming, zoekopdracht, zoekterm, resultaten, zoekresultat, browser, applicatie, database, gebruiker, winkel, winkelwagen, bron$, evenement",
        "niet$, geen$, nooit, niets, helaas",
        "gevonden, beschikbaar, bestaat, bereikbaar, toegankelijk, toegestaan, gemachtigd, bevoegd, geldig, geladen, geopend, weergegeven, getoond, verwerkt, ondersteund, zoekresultat",
        "verwijderd, verplaatst, verlopen, mislukt, fout$, fouten$, foutmelding, geweigerd, verboden, geblokkeerd, opgeschort, uitgeschakeld, onbereikbaar, onderhoud, overbelast, time-out, ongeldig, tijdelijk, uitverkocht, in aanbouw, offline, te veel, niet meer, misgegaan, ging mis, storing",
        "probeer het, probeer later, opnieuw, vernieuw, ververs, laad de, herlaad, ga terug, terug naar, startpagina, neem contact, log in$, meld je aan, meld u aan, controleer$, even geduld, een moment, wordt geladen, binnenkort, doorgestuurd, geen robot, schakel, inschakelen, probeer andere",
    ),
    "ru": (
        "страниц, сайт, адрес, ссылк, файл, документ, стать, содержим, товар, предложени, объявлени, изображени, видео, аккаунт, учетн, учётн, сесси, сеанс, запрос, сервис, сервер, соединени, подключени, доступ$, доступа$, поиск, результат, браузер, приложени, база данных, пользовател, магазин, корзин, ресурс, событи",
        "не$, нет$, ничего, никак, невозможно, к сожалению",
        "найден, доступ, существу, загружен, загрузить, открыт, отобра, показ, разреш, обработ, поддержив, действител, удалось, удаётся, удается",
        "удален, удалён, перемещен, перемещён, истек, истёк, ошибк, отказ, запрещ, заблокир, приостановлен, отключен, отключён, недоступ, обслуживани, перегруж, время ожидания, неверн, временно, распродан, в разработке, слишком много, больше не, пошло не так, сбой",
        "попробуйте, повторите, обновите, перезагрузите, вернитесь, на главную, свяжитесь, обратитесь, войдите, авторизуйтесь, проверьте, подождите, пожалуйста, загрузка, загружается, скоро, перенаправ, не робот, включите, разрешите, измените запрос",
    ),
    "ja": (
        "ページ, サイト, アドレス, リンク, ファイル, 文書, 記事, コンテンツ, 商品, 画像, 動画, アカウント, セッション, リクエスト, サービス, サーバ, 接続, アクセス, 権限, 検索, 結果, ブラウザ, アプリ, データベース, ユーザー, システム, url",
        "ません, ない, なく, なかった, なりました, 不可, 未",
        "見つか, 存在し, 利用でき, 表示でき, アクセスでき, 許可, 読み込め, 接続でき, 該当, 公開, 対応, ありま, いただけ",
        "削除, 移動し, 期限切れ, 失敗, エラー, 拒否, 禁止, ブロック, 停止, 無効, メンテナンス, 混雑, タイムアウト, 不正, 一時的, 売り切れ, 準備中, 工事中, 多すぎ, 障害, 終了し",
        "もう一度, 再度, 後ほど, しばらく, 再読み込み, 更新してください, 戻る, 戻って, トップページ, お問い合わせ, ログインして, ご確認, 確認してください, お待ち, 読み込み中, 近日, まもなく, ロボットで, 有効にし, 許可して",
    ),
}


# Scripts and what must be done with them.
SCRIPTS = "javascript, java script, js$, script$, scripts, scripting, client-side code, active content, cookies, skript, javascrip, スクリプト, クッキー, скрипт, куки"
ENABLING = "enabl, activ, allow, permit, turn on, turn it on, turned off, switch on, switch it on, switched off, unblock, need, requir, accept, support, aktivier, einschalten, eingeschaltet, zulassen, erlaub, habilit, permit, autoris, attiv, abilit, consent, ative$, permita, inschakel, schakel, zet$, sta$, toestaan, включ, разреш, 有効, 許可"


# Strings of which one must occur, in lower case, before a pattern above can match: one pass of an Aho-Corasick
# automaton tells which sentences are worth the patterns, and finds the words of the grammar. A new pattern needs its
# anchor here.
_MARK, _MSG, _FILL = 1, 2, 4
_ANCHORS = {
    _MARK: ["{", "[", "<", "%", "__", "@@", "undefined", "nan", "null", "none", "nil", "$", "#", "||", "*|", "~~", "«", "［", "【", "〇〇", "○○", "(insert", "(enter", "(add", "(type", "(fill"],
    _MSG: [
        "javascript", "java script", "js", "script", "active content", "skript", "スクリプト", "скрипт", "turn it on", "switch it on", "will not work", "cookies",
        "found", "no longer", "not exist", "deleted", "removed", "moved", "never existed", "be shown", "expired", "is gone", "available", "nothing lives", "introuvable", "nicht gefunden", "link ist", "la página", "no encontrada", "página não", "pagina non", "più valido", "niet gevonden", "не найден", "見つか",
        "l'adresse", "la dirección", "o endereço", "het adres", "адрес", "アドレス", "check the",
        "error", "fehler", "erreur", "http 4", "http 5", "service", "internal", "unavailable", "the page", "went wrong", "laden sie", "timed out", "time-out", "timeout", "gateway", "connect", "connection", "serviced", "maintenance", "failed to load", "not be loaded", "try again", "réessayer", "wartung", "mantenimiento", "certificate", "upstream",
        "traceback", "exception", "stack trace", "warning:", 
        "denied", "refused", "forbidden", "permission", "not allowed", "authori", "blocked", "too many", "slow down", "sign in", "log in", "login", "verweigert", "refusé", "interdit", "denegado", "negado", "negato", "запрещ", "geweigerd", "拒否",
        "no result", "no match", "no item", "no entr", "no record", "nothing", "try other", "try different", "0 results", "keine", "aucun", "sin result", "nessun", "nenhum", "geen res",
        "wait", "loading", "coming soon", "one moment", "warten", "patientez", "espere", "attendere", "aguarde", "подождите", "even geduld", "お待ち", "construction", "robot", "your browser", "few seconds",
    ],
    _FILL: [
        "lorem", "ipsum", "dolor", "dummy", "sample", "placeholder", "filler", "before launch", "your content", "your text", "goes here", "click", "edit me", "paragraph", "body copy", "headline", "subline", "header here", "describe what", "todo", "tbd", "item name", "blindtext", "hier steht", "remplacement", "faux", "ejemplo", "relleno", "exemplo", "esempio", "segnaposto", "voorbeeld", "заполнитель", "ダミー", "サンプル",
        "asdf", "qwer", "jkl", "xxx", "test", "foo", "bar", "blah", "abc", "zzz", "aaa",
        "ipsam", "amet", "elit", "magn", "tempor", "labor", "minima", "animus", "amor", "velit", "aliqua", "consect", "exer", "deserun", "pariat", "nisi", "sint", "novera", "culpa", "mollit", "ullam", "quis", "vendis", "vestis", "estor", "occae", "comoda", "fugi", "cupid", "irur", "repreh", "cill",
    ],
}
_automaton = None


def _built():
    """The automaton of anchors (length 0) and words of the grammar (their length, whether they must end a word)."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a, bits = ahocorasick.Automaton(), {}
        for bit, words in _ANCHORS.items():
            for w in words:
                bits.setdefault(w, [0, 0, 0])[0] |= bit
        for groups in [*WORDS.values(), ("",) * 5 + (SCRIPTS, ENABLING)]:
            for bit, words in zip((_T, _N, _V, _F, _A, _SCRIPTS, _ENABLING), groups):
                for w in filter(None, words.split(", ")):
                    bits.setdefault(w.strip("*$"), [0, 0, 0])[0 if w[0] == "*" else 2 if w[-1] == "$" else 1] |= bit
        for w, (free, stem, whole) in bits.items():
            a.add_word(w, (free, stem, whole, len(w), w[0].isalnum() and not _CJK.match(w)))
        a.make_automaton()
        _automaton = a
    return _automaton


def _hints(low: str) -> int:
    """Which groups of patterns can match in a text in lower case, and which groups of words of the grammar are in it."""
    out, n = 0, len(low)
    for end, (free, stem, whole, size, word) in _built().iter(low):
        out |= free
        if (stem | whole) & ~out:
            start = end - size + 1
            if word and start and low[start - 1].isalnum() and low[start - 1].isascii() == low[start].isascii():
                continue
            out |= stem
            if whole and (end + 1 == n or not low[end + 1].isalnum()):
                out |= whole
    return out


def is_message(hints: int, size: int) -> bool:
    """Whether a sentence with these words is a message: a thing with a failure or a denied finding, or a request of
    messages, in a sentence that is not long; or scripts with what is to be done with them."""
    if size > 240:
        return False
    wrong = bool(hints & _F) or (hints & _N and hints & _V)
    if hints & _SCRIPTS and (hints & _ENABLING or wrong):
        return True
    return bool((hints & _T and wrong) or (hints & _A and (size < 120 or hints & _T)) or (hints & _F and size < 40))


def measure(text: str) -> dict[str, int]:
    """What the text consists of: placeholders, and the sizes of template sentences, messages, filler and the rest."""
    out = {"marks": 0, "template": 0, "message": 0, "filler": 0, "told": 0, "content": 0}
    plain = _CHROME.sub("\n", without_code(text))
    out["chrome"] = max(0, len(text) - len(plain))
    for s in _SENTENCE.split(plain):
        s = s.strip()
        if len(s) < 3 and not s.isalnum():
            continue
        n, hints, words = _size(s), _hints(s.lower()), s.split()
        if hints & _MARK:
            marks = len(_PLACEHOLDER.findall(s))
            if marks and (marks > 1 or not _EXPLAINS.search(s)):
                out["marks"] += marks
                out["template"] += n
                continue
        if (hints & _FILL and (_FILLER.search(s) or (len(words) > 2 and 2 * len(_LATIN_WORD.findall(s)) >= len(words)))) or is_made_up_latin(s):
            out["filler"] += n
        elif is_message(hints, n) or (hints & _MSG and _MESSAGE.search(s)):
            told = bool(_TOLD.search(s))
            out["told"] += told
            out["content" if told else "message"] += n
        elif len(s) < 400 and _BAR.match(s):
            out["chrome"] += n
        elif len(words) < 4 and len(s) < 60 and not _CJK.search(s) and s[-1:] not in ".!?":
            out["chrome"] += n  # a name or heading
        else:
            out["content"] += n
    return out


def is_residue(text: str | None, marks_per_1000: float = 1.0, content_share: float = 0.5, beside_one: int = 300) -> bool:
    """Whether the text is residue: unfilled placeholders outside code and explanations, at least ``marks_per_1000`` for
    each 1000 letters of other content, a single one with at most ``beside_one`` letters of other content; or messages
    and filler of which none is told about, with at most ``content_share`` of their size of other content."""
    if not text or not text.strip():
        return False
    hints = _hints(text.lower())
    if not hints & (_MARK | _MSG | _FILL | _F | _A | _V | _SCRIPTS) and not any(is_made_up_latin(x) for x in _SENTENCE.split(text)):
        return False
    m = measure(text)
    if m["marks"] > 1 and 1000 * m["marks"] >= marks_per_1000 * m["content"] or m["marks"] == 1 and m["content"] <= beside_one:
        return True
    bad = m["message"] + m["filler"]
    return bad > 0 and not m["told"] and m["content"] <= content_share * bad


def find_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, residue) of every row of ``df``. Null, empty and blank texts are no residue; repeated rows come out as
    often as they come in; other columns are ignored. A map over Arrow batches: no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([is_residue(t) for t in b.column(1).to_pylist()], pa.bool_())], [id_col, "residue"])

    return spread(df.select(id_col, F.col(text_col).alias("_text")), id_col).mapInArrow(run, f"{id_col} {kind}, residue boolean")


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is no residue, with all their columns; judged row by row, without a shuffle."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([not is_residue(t) for t in b.column(names.index(text_col)).to_pylist()], pa.bool_())
            yield b.filter(keep)

    return spread(df, id_col).mapInArrow(run, df.schema)
