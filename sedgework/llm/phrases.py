"""What broken tools leave in texts, in the languages of the corpus. Compared after folding, see residue.fold."""

from __future__ import annotations

#: Messages of error pages of servers, proxies, content networks, content systems, browsers and interpreters. Variable parts (numbers, paths, names) are left out, so that a message can be several phrases.
ERRORS = (
    "internal server error", "the server met an unexpected condition", "the server encountered an internal error", "the server encountered an unexpected condition", "bad gateway", "gateway timeout", "gateway time-out", "the server returned an invalid or incomplete response", "the proxy server received an invalid response from an upstream server",
    "service temporarily unavailable", "service unavailable", "the server is temporarily unable to service your request", "due to maintenance downtime or capacity problems", "upstream request timeout", "no healthy upstream", "varnish xid", "varnish cache server", "guru meditation",
    "the requested url", "was not found on this server", "page not found", "the page you are looking for does not exist or has been moved", "the page you requested could not be found", "this page could not be found", "the page cannot be found", "this page isn't available", "this page does not exist", "we can't find that page", "we can't find the page you're looking for", "we couldn't find that page", "it looks like nothing was found at this location", "the resource you are looking for has been removed", "had its name changed, or is temporarily unavailable", "the requested resource was not found", "no such bucket", "nosuchkey", "the specified key does not exist",
    "access denied", "you don't have permission to view", "you do not have permission to access", "you don't have permission to access", "authorization required", "this server could not verify that you are authorized", "sorry, you have been blocked", "you are unable to access", "this website is using a security service to protect itself", "the action you just performed triggered the security solution", "cloudflare ray id", "performance & security by cloudflare", "your access to this site has been limited", "request blocked", "the request could not be satisfied", "generated by cloudfront",
    "we're sorry, something went wrong on our end", "something went wrong", "please try again in", "please try again later", "an unexpected error has occurred", "an error occurred while processing your request", "an application error occurred on the server", "application error", "server error in '/' application", "there has been a critical error on this website", "there has been a critical error on your website", "learn more about troubleshooting wordpress", "the website encountered an unexpected error", "briefly unavailable for scheduled maintenance", "check back in a minute", "this account has been suspended", "the site is currently unavailable",
    "a database query error has occurred", "error establishing a database connection", "function: page::load", "lost connection", "you have an error in your sql syntax", "sqlstate[", "too many connections",
    "traceback (most recent call last):", "keyerror:", "valueerror:", "typeerror:", "attributeerror:", "nameerror:", "indexerror:", "modulenotfounderror:", "exception in thread", "nullpointerexception", "stack trace", "unhandled exception", "undefined index:", "undefined variable", "segmentation fault", "core dumped", "uncaught exception", "uncaught typeerror",
    "fatal error: maximum execution time of", "fatal error:", "allowed memory size", "warning: mysql_connect()", "failed to open stream", "lua error in module", "attempt to index a nil value", "lua error", "parse error: syntax error", "script error",
    "this site can't be reached", "refused to connect", "took too long to respond", "server ip address could not be found", "unable to connect", "this webpage is not available", "err_connection_", "dns_probe_finished", "connection refused", "connection timed out", "connection reset", "too many requests", "bad request", "request timeout", "your connection is not private",
    "die seite wurde nicht gefunden", "seite nicht gefunden", "die angeforderte seite", "interner serverfehler", "bitte versuchen sie es in", "bitte versuchen sie es spater erneut", "zugriff verweigert (vorgang", "zugriff verweigert", "der server ist nicht erreichbar", "dienst nicht verfugbar", "die website ist nicht erreichbar", "ein unerwarteter fehler ist aufgetreten",
    "une erreur interne est survenue", "une erreur est survenue", "veuillez reessayer plus tard", "page introuvable", "la page que vous recherchez", "acces refuse au serveur", "acces refuse", "acces interdit", "service indisponible", "le serveur ne repond pas", "erreur interne du serveur",
    "no se encontro la pagina", "pagina no encontrada", "la pagina que busca no existe", "el servidor no esta disponible", "intentelo de nuevo en", "intentelo de nuevo mas tarde", "error interno del servidor", "acceso denegado", "servicio no disponible", "ha ocurrido un error",
    "страница не найдена", "запрашиваемая страница не найдена", "внутренняя ошибка сервера", "попробуйте еще раз", "попробуйте позже", "сервер недоступен", "доступ запрещен", "сервис временно недоступен", "повторите попытку", "произошла ошибка",
    "nie znaleziono strony", "strona nie zostala znaleziona", "strona nie istnieje", "wewnetrzny blad serwera", "sprobuj ponownie za", "sprobuj ponownie pozniej", "brak dostepu do strony", "brak dostepu", "odmowa dostepu", "serwer jest niedostepny", "wystapil blad",
    "ページが見つかりません", "お探しのページは", "サーバーで問題が発生しました", "しばらくしてから再度お試しください", "内部サーバーエラー", "アクセスが拒否されました", "サービスは一時的に利用できません", "エラーが発生しました",
    "pagina nao encontrada", "a pagina que voce procura", "erro interno do servidor", "ocorreu um erro", "acesso negado", "servico indisponivel", "tente novamente mais tarde", "o servidor nao esta disponivel",
    "pagina non trovata", "la pagina che stai cercando", "errore interno del server", "si e verificato un errore", "accesso negato", "servizio non disponibile", "riprova piu tardi",
    "页面不存在", "找不到页面", "您访问的页面不存在", "您请求的页面", "服务器内部错误", "服务器错误", "服务暂时不可用", "请稍后再试", "访问被拒绝", "系统繁忙", "頁面不存在", "找不到網頁", "伺服器錯誤", "請稍後再試",
    "pagina niet gevonden", "interne serverfout", "toegang geweigerd", "er is een fout opgetreden", "probeer het later opnieuw", "sayfa bulunamadi", "sunucu hatasi", "erisim engellendi", "sidan kunde inte hittas", "페이지를 찾을 수 없습니다", "서버 오류", "접근이 거부되었습니다",
)

#: Status lines are made of these by the rule below: a code with its reason, or beside the word for an error.
STATUS = {400: "bad request", 401: "unauthorized", 403: "forbidden", 404: "not found", 405: "method not allowed", 408: "request timeout", 410: "gone", 429: "too many requests", 500: "internal server error", 502: "bad gateway", 503: "service unavailable", 504: "gateway timeout"}
ERROR_WORDS = ("error", "http", "http error", "error code", "fehler", "erreur", "код", "ошибка", "blad", "erro", "errore", "fout", "hata", "エラー", "错误", "錯誤", "오류")

#: Words and pieces that such messages are made of, and that prose has as well. They count only near something that counts by itself.
PARTS = (
    "request", "timed out after", "backend", "not found", "on this server", "reference #", "forbidden", "minutes", "seconds", "error", "file \"", ".py\", line", "in expand", "exceeded in", ".php on line", ".php", "on line", "at line", "oops!", "sorry", "code", "server", "page", "url", "please", "ray id",
    "minuten erneut", "fehler", "erreur", "(ref.", "minutos", "ошибка", "код", "минут", "minut", "blad", "エラー", "erro", "errore", "minuti",
)

#: Text put where text was to come.
FILLERS = (
    "this is sample text", "sample text", "text goes here", "your text goes here", "write your article here", "replace this paragraph with your own words", "more content coming soon, dummy line", "more content coming soon", "content coming soon", "body copy to come", "dummy text", "dummy line", "filler text", "insert non-formatted text here", "insert text here", "lorem ipsum dolor sit amet", "lorem ipsum", "the quick brown fox jumps over the lazy dog", "bold text", "italic text", "headline text",
    "hier steht ein beispieltext", "platzhalter fur den artikel", "text folgt spater", "das ist ein blindtext", "beispieltext", "blindtext", "hier text einfugen", "inhalt folgt",
    "inserez votre texte ici", "ceci est un faux texte", "texte d'exemple", "contenu a venir", "faux texte", "votre texte ici",
    "escriba aqui su articulo", "texto de relleno", "esto es un texto de ejemplo", "texto de ejemplo", "contenido proximamente", "inserte aqui su texto",
    "это пример текста", "здесь будет текст", "вставьте сюда свой текст", "пример текста", "текст появится позже", "текст-заполнитель", "рыба-текст",
    "tu wpisz tekst artykulu", "to jest tekst przykladowy", "tresc w przygotowaniu", "tekst przykladowy", "tutaj wpisz tekst",
    "ここに本文を入力してください", "これはダミーテキストです", "サンプル文章", "ダミーテキスト", "準備中です", "ここにテキストを入力",
)

#: Notices that the page needs scripts.
SCRIPTS = (
    "please enable javascript to view this page", "please enable javascript", "enable javascript", "this site requires javascript", "turn it on in your browser settings and reload", "if nothing happens, activate javascript", "loading...",
    "your browser does not support client-side scripting, so the article cannot be displayed", "your browser does not support javascript", "without js the reader won't load", "you need to have scripts switched on to read", "javascript is disabled", "javascript is required", "you need to enable javascript to run this app",
    "checking your browser before you proceed", "checking your browser", "this takes up to", "seconds; scripts and cookies must be allowed", "scripts and cookies must be allowed", "please allow cookies",
    "you must turn on javascript to use this application", "turn on javascript", "javascript must be enabled", "this page requires javascript", "this app requires javascript", "this application requires javascript", "javascript is not enabled", "javascript is turned off", "please turn javascript on", "requires javascript to be enabled", "enable javascript and cookies to continue", "verify you are human by completing the action below", "verifying you are human", "needs to review the security of your connection before proceeding", "ddos protection by cloudflare", "please wait while we verify your browser", "just a moment...", "your browser is out of date", "this site is best viewed with javascript",
    "bitte aktivieren sie javascript, um diese seite anzuzeigen", "bitte aktivieren sie javascript", "ohne eingeschaltete skripte kann der inhalt nicht dargestellt werden",
    "veuillez activer javascript pour lire cette page", "veuillez activer javascript", "votre navigateur n'execute pas les scripts : contenu indisponible", "votre navigateur n'execute pas les scripts", "contenu indisponible",
    "active javascript para ver esta pagina", "este sitio necesita que su navegador ejecute scripts", "habilite javascript",
    "включите javascript, чтобы увидеть страницу", "включите javascript", "для просмотра нужна поддержка скриптов в браузере",
    "wlacz obsluge javascript, aby zobaczyc strone", "wlacz obsluge javascript", "bez skryptow nie mozna wyswietlic tresci",
    "このページを表示するにはjavascriptを有効にしてください", "javascriptを有効にしてください", "スクリプトが無効のため内容を表示できません",
    "ative o javascript", "e necessario ativar o javascript", "habilite o javascript", "por favor, ative o javascript", "este site requer javascript", "abilita javascript", "attiva javascript", "e necessario abilitare javascript", "per visualizzare questa pagina e necessario javascript", "questo sito richiede javascript",
    "请启用javascript", "请开启javascript", "您需要启用javascript", "需要javascript支持", "请在浏览器中启用", "請啟用javascript", "schakel javascript in", "javascript is uitgeschakeld", "javascript'i etkinlestirin", "aktivera javascript", "javascript를 활성화",
    "sie mussen javascript aktivieren", "javascript ist deaktiviert", "vous devez activer javascript", "javascript est desactive", "necesita habilitar javascript", "javascript esta desactivado", "необходимо включить javascript", "javascript отключен", "musisz wlaczyc javascript", "javascript jest wylaczony", "javascriptが無効です",
)

#: Words of the Latin filler that printers use. A text of them alone is filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

#: Names of fields that templates have. Needed only where the way of writing alone doesn't tell a placeholder.
FIELDS = frozenset(
    "name title year date district population founder value n city author place text number id field email phone address company country url description"
    " ort kreis jahr einwohner titel datum wert stadt nom canton annee titre valeur ville nombre partido ano poblacion titulo fecha valor ciudad"
    " название округ год население имя дата значение город nazwa gmina rok ludnosc tytul data wartosc miasto 名前 地域 人口 年 題名 日付".split()
)

#: Tags of HTML and of wikis. Any other name between angle brackets that is nowhere closed is a placeholder.
TAGS = frozenset(
    "a abbr address area article aside audio b base bdi bdo blockquote body br button canvas caption cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output p picture pre progress q rp rt ruby s samp script search section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr center big nobr"
    " ref references gallery nowiki math noinclude includeonly onlyinclude syntaxhighlight score timeline poem hiero imagemap section templatestyles templatedata categorytree charinsert inputbox graph maplink mapframe indicator langconvert ce chem translate tvar languages".split()
)

#: What editors put into square brackets, and words that are put into quotations there.
EDITORIAL = frozenset("sic note notes edit citation needed who when where why clarification clarify date unsure year quote music applause laughter laughs inaudible silence ellipsis emphasis added original italics ibid recte redacted deleted unknown illegible missing the a an he she it they we you his her its their our this that these those and or but of in on at to for from with as by is was are were i my me him them us not no all some one der die das und le la les et el los y il lo e o os".split())

#: Behaviour switches of wikis, which look like placeholders.
SWITCHES = frozenset("notoc forcetoc toc noeditsection newsectionlink nonewsectionlink nogallery hiddencat expectunusedcategory index noindex staticredirect disambig notitleconvert notc nocontentconvert nocc archivedtalk notalk".split())

#: Names that web servers sign their error pages with.
SERVERS = ("nginx", "openresty", "tengine", "apache", "apache tomcat", "cloudflare", "cloudfront", "microsoft-iis", "iis", "lighttpd", "litespeed", "caddy", "varnish", "squid", "envoy", "gunicorn", "jetty", "haproxy", "akamaighost")

#: Ways to speak of a placeholder instead of leaving one.
MENTIONS = ("form-letter", "form letter", "is left in", "are left in", "in the draft", "placeholder", "parameter", "syntax", "is written", "notation", "boilerplate", "struck out", "filled in before", "platzhalter", "vorlage", "espace reserve", "gabarit", "marcador", "plantilla", "заполнитель", "шаблон", "symbol zastepczy", "szablon", "プレースホルダ", "テンプレート")
