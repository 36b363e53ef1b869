"""Written examples of residue and of its opposite, from which the residue models are fitted.

One line is one example, by kind and language. ``contrast`` holds lines that talk about templates,
errors or scripts, or are code and notation with the same signs: they must not be found. Unfilled
slots are made from delimiters and names by rule (:func:`slot_lines`), as their shape matters and not their words.
"""

from __future__ import annotations

import itertools

FILLER = {
    "la": """Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti.
Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet.
Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.
Curabitur pretium tincidunt lacus, nulla gravida orci a odio, et tempus feugiat.
Maecenas vitae mattis tellus, nullam quis imperdiet augue, vestibulum auctor ornare leo.
Aenean nec lorem, in porttitor, donec laoreet nonummy augue, suspendisse dui purus.
Integer in mauris eu nibh euismod gravida, duis ac tellus et risus vulputate vehicula.
Praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat.
Fusce lobortis lorem at ipsum semper sagittis, phasellus ultrices nulla quis nibh.
Morbi in sem quis dui placerat ornare, pellentesque odio nisi, euismod in, pharetra a.
Consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore et dolore magna aliquyam erat.
Stet clita kasd gubergren, no sea takimata sanctus est lorem ipsum dolor sit amet.
Cras elementum ultrices diam, proin quam etiam ultrices, suspendisse in justo eu magna luctus.
Etiam sit amet orci eget eros faucibus tincidunt, duis leo, sed fringilla mauris sit amet nibh.""",
    "en": """This is placeholder text and will be replaced later.
Placeholder copy. Replace me before publishing.
Replace this text with your own content.
Type your text here.
Your content goes here.
Your headline here
Insert description here.
Write something about yourself here.
The summary of this item will appear here.
A short description will be placed here soon.
The text of this section goes here.
This paragraph is only here to fill the page.
This sentence has no meaning and only fills the space.
This is just some dummy copy for the design.
Dummy description for layout purposes only.
Sample content for preview only.
Example text for demonstration purposes.
This is an example page; it has no real content yet.
Just another blank page.
Page under construction.
This section is under construction.
More information coming soon.
Details coming soon!
Content to be added.
Text to be supplied.
Nothing here yet.
There is nothing to see here at the moment.
Description not yet written.
No description yet.
Hello world! This is my first post.
Welcome to your new site. This is your first post. Edit or delete it, then start writing!
This is a test entry, please ignore.
Test test test
testing 1 2 3 testing
This is only a test.
Testing, ignore this message.
Blah blah blah and so on and so forth.
blah blah blah blah blah blah
bla bla bla bla
foo bar baz qux foo bar baz
foo foo foo bar bar
asdf asdf asdf jkl asdf
asdfasdf qwerty qwerty
qwertyuiop asdfghjkl zxcvbnm
aaa bbb ccc ddd eee fff
xxx xxx xxx xxx
xxxx xxxxx xxx xxxxxx
abc abc abc abc abc
test foo bar blah abc xyz test
jkl qwer asdf hjkl uiop
sdfg sdfg dfgh dfgh
the quick brown fox jumps over the lazy dog the quick brown fox
The quick brown fox jumps over the lazy dog.
Dummy title
Dummy entry, fills the form.
Sample text
Filler text
Untitled document""",
    "de": """Dies ist ein Blindtext.
Dies ist ein Platzhaltertext und wird später ersetzt.
Hier steht ein Beispieltext.
Hier könnte Ihr Text stehen.
Hier entsteht eine neue Seite.
Ihr Text kommt hier hin.
Bitte diesen Text ersetzen.
Dieser Absatz dient nur als Platzhalter.
Dieser Satz hat keinen Inhalt und füllt nur die Seite.
Nur ein Fülltext ohne Bedeutung.
Fülltext für die Vorschau.
Mustertext, bitte überschreiben.
Der Inhalt folgt demnächst.
Inhalt wird noch ergänzt.
Beschreibung folgt.
Weitere Angaben folgen in Kürze.
Noch kein Inhalt vorhanden.
Noch keine Beschreibung.
Diese Seite befindet sich im Aufbau.
Seite im Aufbau
Überall dieselbe alte Leier, weit hinten hinter den Wortbergen leben die Blindtexte.
Ein kleines Bächlein namens Duden fließt durch ihren Ort.
Das hier ist nur ein Test.
Testeintrag, bitte nicht beachten.
Hallo Welt! Dies ist der erste Beitrag.
Franz jagt im komplett verwahrlosten Taxi quer durch Bayern.
Text Text Text Text Text.
Bla bla bla und so weiter.
Beispielinhalt nur zur Ansicht.
Diese Zeilen sind ohne Sinn und füllen nur den Platz.
Hier wird bald mehr zu lesen sein.
Blindtext
Platzhalter
Mustertitel""",
    "fr": """Ceci est un texte de remplissage.
Ceci est un faux texte pour la maquette.
Faux texte à remplacer avant la publication.
Votre texte ici.
Insérez votre texte ici.
Saisissez une description ici.
Remplacez ce texte par votre contenu.
Le texte de cette section viendra ici.
La description sera ajoutée ici.
Texte provisoire.
Texte d’exemple.
Ce paragraphe ne sert qu’à occuper l’espace.
Cette phrase n’a pas de sens et remplit la page.
Contenu à venir.
Contenu bientôt disponible.
Plus d’informations bientôt.
Description à compléter.
Pas encore de description.
Aucun contenu pour le moment.
Page en construction.
Cette section est en cours de rédaction.
Exemple de contenu pour l’aperçu.
Ceci est un test, merci de l’ignorer.
Ceci n’est qu’un essai.
Bonjour tout le monde ! Ceci est votre premier article.
Bienvenue sur votre nouveau site, modifiez ou supprimez ce message.
Portez ce vieux whisky au juge blond qui fume.
Bla bla bla et ainsi de suite.
Texte texte texte texte.
Un court résumé prendra place ici.
Rien à voir ici pour l’instant.
Titre provisoire""",
    "es": """Este es un texto de relleno.
Texto de relleno para la maqueta.
Texto de ejemplo que será sustituido.
Escriba aquí su texto.
Su texto va aquí.
Inserte la descripción aquí.
Reemplace este texto por su contenido.
El texto de esta sección irá aquí.
Aquí aparecerá la descripción.
La descripción se añadirá más tarde.
Texto provisional.
Este párrafo solo sirve para ocupar espacio.
Esta frase no significa nada y solo llena la página.
Contenido próximamente.
Contenido en preparación.
Más información próximamente.
Descripción pendiente.
Todavía no hay descripción.
Todavía no hay contenido.
Página en construcción.
Esta sección está en construcción.
Contenido de ejemplo para la vista previa.
Esto es una prueba, por favor ignórela.
Solo es una prueba.
¡Hola mundo! Esta es tu primera entrada.
Bienvenido a tu nuevo sitio; edita o borra este mensaje.
El veloz murciélago hindú comía feliz cardillo y kiwi.
Bla bla bla y así sucesivamente.
Texto texto texto texto.
Nada que ver aquí por ahora.
Título de prueba
Texto simulado""",
}

ERROR = {
    "en": """Page not found
The page cannot be found.
We can't find the page you're looking for.
Sorry, we couldn't find that page.
The page you were looking for doesn't exist or has been moved.
This page isn't available right now.
This page is not available in your region.
The link you followed may be broken or expired.
Looks like this link is broken.
The requested URL /index was not found on this server.
The requested resource could not be found on this server.
The record you requested does not exist.
The item you are looking for has been removed.
The document has been deleted or is no longer available.
This article could not be loaded.
This entry cannot be displayed at the moment.
The entry could not be opened.
The data could not be retrieved.
No results could be loaded. Try again.
Unable to load this content. Please refresh the page.
Unable to connect to the database.
Could not establish a connection to the server.
Can't reach this page.
This site can't be reached.
The server took too long to respond.
The server is not responding. Please try again in a few minutes.
The server encountered an internal error and could not complete your request.
The server is temporarily busy, try again later.
The service is currently unavailable.
This service is down for maintenance. We will be back shortly.
We are performing scheduled maintenance and will be back online soon.
The site is undergoing maintenance.
The system is temporarily offline for an upgrade.
Something went wrong. Please try again.
Oops, something broke on our end.
Whoops, that wasn't supposed to happen.
Whoops, looks like something went wrong.
Well, this is embarrassing. We hit a snag.
An error occurred while processing your request.
An unexpected error has occurred. Please contact support.
An unknown error occurred. Reload the page and try again.
A problem occurred while loading the page.
An exception was thrown while rendering the view.
Unhandled exception in handler, the request was aborted.
Fatal error: call to undefined function in /var/www/html/index.php on line 42
Warning: mysql_connect(): access denied for user
There has been a critical error on this website.
Error establishing a database connection
Application error: a client-side exception has occurred
Request failed with status code 500
Error code: 1020
Error 404
HTTP 500
HTTP Error 403
Error 503 Backend fetch failed
404 - File or directory not found.
Whitelabel Error Page. This application has no explicit mapping for /error.
404 Not Found
400 Bad Request
401 Unauthorized
402 Payment Required
403 Forbidden
405 Method Not Allowed
406 Not Acceptable
408 Request Timeout
409 Conflict
410 Gone
413 Payload Too Large
414 URI Too Long
422 Unprocessable Entity
429 Too Many Requests
451 Unavailable For Legal Reasons
500 Internal Server Error
501 Not Implemented
502 Bad Gateway
503 Service Unavailable
504 Gateway Timeout
522 Connection timed out
Not Found
Bad Gateway
Request timeout
Gateway timeout
Internal server error
Service unavailable
Too many requests
Connection refused
Connection reset by peer
Connection timed out: the server did not answer within 30 seconds.
The request has timed out.
The operation timed out, please retry.
You have sent too many requests in a short time. Slow down.
Rate limit exceeded. Try again in an hour.
You have reached your limit for today.
Access denied
Access to this resource is forbidden.
You are not authorized to access this page.
You do not have the rights to see this document.
You need permission to access this item.
Your account has no access to this data.
Please sign in to continue.
Log in to see this content.
You must be signed in to view this record.
You have been logged out. Log in again.
Your session is no longer valid. Please sign in again.
Session expired
Your login token is invalid or has expired.
Your IP address has been blocked.
Sorry, you have been blocked. You are unable to access this site.
Checking your browser before you continue.
Please wait while we verify that you are not a robot.
Verify you are human by completing the action below.
Confirm that you are a person to go on.
Please complete the security check to access the website.
DNS_PROBE_FINISHED_NXDOMAIN
ERR_CONNECTION_REFUSED
ERR_TOO_MANY_REDIRECTS
ERR_NAME_NOT_RESOLVED
NS_ERROR_NET_TIMEOUT
SSL_ERROR_BAD_CERT_DOMAIN
<title>Error</title><h1>An error occurred.</h1>
<html><head><title>403 Forbidden</title></head><body><center><h1>403 Forbidden</h1></center><hr><center>nginx</center></body></html>
<html><head><title>Object moved</title></head><body><h1>Server Error</h1><p>Please try again later.</p></body></html>
{"error": "not_found", "status": 404, "message": "No route matches"}
{"code": 500, "message": "Internal Server Error", "error": true}
{"status": "error", "message": "Something went wrong"}
{"statusCode": 429, "error": "Too Many Requests", "message": "Rate limit is exceeded."}
Please try again later.
Please reload the page.
Refresh the page to try again.
If the problem persists, contact the administrator.
Go back to the home page.
We apologize for the inconvenience.""",
    "de": """Seite nicht gefunden
Die Seite wurde nicht gefunden.
Diese Seite gibt es nicht mehr.
Die gesuchte Seite ist nicht vorhanden.
Die aufgerufene Adresse existiert nicht.
Der Link ist ungültig oder abgelaufen.
Der gewünschte Eintrag ist nicht mehr verfügbar.
Der Eintrag konnte nicht geöffnet werden.
Das Dokument wurde gelöscht oder verschoben.
Der Datensatz kann derzeit nicht angezeigt werden.
Die Daten konnten nicht geladen werden.
Der Inhalt kann im Moment nicht dargestellt werden.
Es ist ein Fehler aufgetreten.
Ein interner Fehler ist aufgetreten. Bitte versuchen Sie es später noch einmal.
Beim Laden der Seite ist ein Problem aufgetreten.
Beim Verarbeiten der Anfrage trat ein Fehler auf.
Ups, da ist etwas schiefgelaufen.
Hoppla! Das hat leider nicht geklappt.
Leider ist etwas schiefgegangen.
Interner Serverfehler
Serverfehler
Der Server antwortet nicht.
Der Server ist zurzeit nicht erreichbar.
Der Server ist ausgelastet, bitte warten.
Dienst nicht verfügbar
Der Dienst steht momentan nicht zur Verfügung.
Keine Verbindung zur Datenbank möglich.
Die Verbindung zum Server wurde unterbrochen.
Zeitüberschreitung der Anfrage
Die Anfrage hat zu lange gedauert.
Zugriff verweigert
Der Zugriff auf diese Seite ist gesperrt.
Sie sind nicht berechtigt, diesen Inhalt zu sehen.
Ihnen fehlen die Rechte für diese Aktion.
Bitte melden Sie sich an.
Melden Sie sich an, um fortzufahren.
Ihre Sitzung ist nicht mehr gültig.
Sie wurden abgemeldet.
Zu viele Anfragen in kurzer Zeit.
Bitte versuchen Sie es in einigen Minuten erneut.
Bitte laden Sie die Seite neu.
Wir führen Wartungsarbeiten durch und sind bald zurück.
Die Seite wird gerade gewartet.
Fehler 404
Fehler 500: interner Fehler
Bitte bestätigen Sie, dass Sie kein Roboter sind.
Einen Moment, Ihr Browser wird überprüft.
Wenden Sie sich an den Administrator.
Wir bitten um Entschuldigung.""",
    "fr": """Page non trouvée
La page n’a pas été trouvée.
Cette page n’existe plus.
La page que vous cherchez est introuvable.
L’adresse demandée n’existe pas.
Le lien est rompu ou a expiré.
La fiche demandée n’est plus disponible.
Cet article a été supprimé.
Le document a été déplacé ou effacé.
L’entrée ne peut pas être ouverte pour l’instant.
Les données n’ont pas pu être chargées.
Impossible de charger ce contenu.
Impossible d’afficher la page.
Une erreur est survenue.
Une erreur interne s’est produite, merci de réessayer.
Une erreur s’est produite lors du traitement de votre demande.
Un problème est survenu pendant le chargement.
Oups, quelque chose s’est mal passé.
Mince ! Cela n’a pas fonctionné.
Désolé, nous avons rencontré un problème.
Erreur interne du serveur
Erreur du serveur
Le serveur ne répond pas.
Le serveur est momentanément inaccessible.
Le serveur est saturé, veuillez patienter.
Service indisponible
Le service n’est pas disponible actuellement.
Connexion à la base de données impossible.
La connexion au serveur a été interrompue.
Délai d’attente dépassé
La requête a pris trop de temps.
Accès refusé
L’accès à cette page est interdit.
Vous n’êtes pas autorisé à consulter ce contenu.
Vous n’avez pas les droits nécessaires.
Veuillez vous identifier.
Connectez-vous pour continuer.
Votre session n’est plus valide.
Vous avez été déconnecté.
Vous avez envoyé trop de requêtes.
Veuillez réessayer dans quelques minutes.
Merci de recharger la page.
Le site est en cours de maintenance et sera bientôt de retour.
Maintenance en cours.
Erreur 404
Erreur 500 : erreur interne
Veuillez confirmer que vous n’êtes pas un robot.
Un instant, nous vérifions votre navigateur.
Contactez l’administrateur.
Veuillez nous excuser pour la gêne occasionnée.""",
    "es": """Página no encontrada
No encontramos la página.
Esta página ya no existe.
La página que busca no se encuentra.
La dirección solicitada no existe.
El enlace está roto o ha caducado.
La ficha solicitada ya no está disponible.
Este artículo ha sido eliminado.
El documento fue movido o borrado.
La entrada no se puede abrir en este momento.
No se pudieron cargar los datos.
No es posible cargar este contenido.
No se puede mostrar la página.
Ha ocurrido un error.
Ocurrió un error interno, vuelva a intentarlo.
Se produjo un error al procesar su solicitud.
Hubo un problema durante la carga.
Vaya, algo salió mal.
¡Ups! Esto no ha funcionado.
Lo sentimos, hemos tenido un problema.
Error interno del servidor
Error del servidor
El servidor no responde.
El servidor no está accesible por el momento.
El servidor está saturado, espere por favor.
Servicio no disponible
El servicio no está disponible actualmente.
No se pudo conectar a la base de datos.
Se ha perdido la conexión con el servidor.
Tiempo de espera agotado
La solicitud tardó demasiado.
Acceso denegado
El acceso a esta página está prohibido.
No está autorizado para ver este contenido.
No tiene los permisos necesarios.
Debe identificarse.
Inicie sesión para continuar.
Su sesión ya no es válida.
Se ha cerrado su sesión.
Ha enviado demasiadas solicitudes.
Inténtelo de nuevo dentro de unos minutos.
Vuelva a cargar la página.
El sitio está en mantenimiento y volverá pronto.
Mantenimiento en curso.
Error 404
Error 500: error interno
Confirme que no es un robot.
Un momento, estamos comprobando su navegador.
Póngase en contacto con el administrador.
Disculpe las molestias.""",
}

SCRIPT = {
    "en": """JavaScript is required
JavaScript is disabled
JavaScript must be enabled.
JavaScript must be enabled to use this feature.
Please enable JavaScript.
Please enable JavaScript in your browser to continue.
Please turn on JavaScript and reload the page.
Please allow scripts for this page.
Please switch on scripting and try again.
Enable JavaScript and cookies to continue
Allow JavaScript to load the chart.
Activate scripts in the browser settings to see the table.
You need JavaScript to run this app.
You need to turn on scripts to see this figure.
You must have JavaScript enabled in order to use this site.
To see this content, activate JavaScript.
To use all functions of this website, JavaScript has to be turned on.
This page needs JavaScript.
This page works best with JavaScript enabled.
This website requires JavaScript to work properly.
This application requires scripts to be allowed.
This content cannot be shown without JavaScript.
The viewer will not load because scripts are blocked.
The interactive map needs scripting to be on.
Without JavaScript this page will not work correctly.
We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser.
It appears your browser has JavaScript turned off.
It looks like scripts are blocked in your browser.
Your browser does not support JavaScript!
Your browser does not run scripts, so nothing can be shown here.
Your browser's scripts are turned off.
Scripts are disabled. Turn them on to go on.
Scripting is turned off in this browser.
Script blocking prevents this page from being displayed.
Turn off your script blocker to load the page.
Disable the ad blocker and allow scripts to continue.
<noscript>You need to enable JavaScript to run this app.</noscript>
<noscript>Please turn on scripts.</noscript>
<noscript><p>JavaScript is needed to show this content.</p></noscript>
Loading... JavaScript required
Change your browser settings to allow scripts.
Turn it on in the settings and reload.""",
    "de": """JavaScript ist erforderlich
JavaScript ist deaktiviert
JavaScript muss aktiviert sein.
Bitte aktivieren Sie JavaScript.
Bitte JavaScript einschalten und die Seite neu laden.
Bitte erlauben Sie Skripte für diese Seite.
Bitte lassen Sie die Ausführung von Skripten zu.
Schalten Sie Skripte ein, um die Tabelle zu sehen.
Sie benötigen JavaScript, um diese Anwendung zu nutzen.
Sie müssen Skripte erlauben, damit die Abbildung erscheint.
Um alle Funktionen zu nutzen, müssen Sie JavaScript aktivieren.
Diese Seite funktioniert nur mit JavaScript.
Diese Seite setzt JavaScript voraus.
Diese Webseite benötigt JavaScript.
Ohne JavaScript kann diese Seite nicht angezeigt werden.
Ohne Skripte wird hier nichts dargestellt.
Die Anzeige erfordert aktivierte Skripte.
Die Karte kann ohne JavaScript nicht geladen werden.
Ihr Browser unterstützt kein JavaScript.
In Ihrem Browser ist JavaScript ausgeschaltet.
Ihr Browser blockiert Skripte.
Skripte sind in Ihrem Browser gesperrt.
Skripte sind deaktiviert, bitte einschalten.
Es sieht so aus, als wären Skripte abgeschaltet.
Deaktivieren Sie den Skriptblocker, um fortzufahren.
<noscript>Bitte aktivieren Sie JavaScript.</noscript>
Ändern Sie die Einstellungen Ihres Browsers und laden Sie neu.""",
    "fr": """JavaScript est requis
JavaScript est désactivé
JavaScript doit être activé.
Veuillez activer JavaScript.
Merci d’activer JavaScript et de recharger la page.
Veuillez autoriser les scripts pour cette page.
Autorisez l’exécution des scripts pour voir le tableau.
Activez JavaScript pour continuer.
Vous devez activer JavaScript pour utiliser cette application.
Il faut autoriser les scripts pour afficher la figure.
Pour profiter de toutes les fonctions, activez JavaScript.
Cette page ne fonctionne qu’avec JavaScript.
Cette page a besoin de JavaScript.
Ce site nécessite JavaScript pour fonctionner.
Sans JavaScript, cette page ne peut pas s’afficher.
Sans scripts, rien ne peut être montré ici.
L’affichage requiert des scripts activés.
La carte ne peut pas être chargée sans JavaScript.
Votre navigateur ne prend pas en charge JavaScript.
JavaScript est désactivé dans votre navigateur.
Votre navigateur bloque les scripts.
Les scripts sont bloqués, veuillez les autoriser.
Il semble que les scripts soient désactivés.
Désactivez votre bloqueur de scripts pour continuer.
<noscript>Veuillez activer JavaScript.</noscript>
Modifiez les réglages de votre navigateur puis rechargez.""",
    "es": """Se requiere JavaScript
JavaScript está desactivado
JavaScript debe estar activado.
Por favor, active JavaScript.
Active JavaScript y vuelva a cargar la página.
Permita los scripts en esta página.
Permita la ejecución de scripts para ver la tabla.
Active JavaScript para continuar.
Debe activar JavaScript para usar esta aplicación.
Hay que permitir los scripts para mostrar la figura.
Para usar todas las funciones, habilite JavaScript.
Esta página solo funciona con JavaScript.
Esta página necesita JavaScript.
Este sitio requiere JavaScript para funcionar.
Sin JavaScript esta página no se puede mostrar.
Sin JavaScript no podemos mostrar nada.
Sin scripts no se muestra nada aquí.
La vista requiere scripts activados.
El mapa no se puede cargar sin JavaScript.
Su navegador no admite JavaScript.
JavaScript está deshabilitado en su navegador.
Su navegador bloquea los scripts.
Los scripts están bloqueados, por favor permítalos.
Parece que los scripts están desactivados.
Desactive el bloqueador de scripts para continuar.
<noscript>Por favor, active JavaScript.</noscript>
Cambie los ajustes de su navegador y recargue.""",
}

#: Sentences around slots: neither a slot's words nor these matter, only that a slot stands in running text.
SLOT_FRAMES = """Dear @,
Hello @, welcome back!
The @ of @ was measured on @.
Results for @ are shown in table 0.
Order @ was shipped to @ on @.
We found @ in @ of all cases.
Contact: @
Name: @
Title: @ (@)
# @
@
Der Wert von @ liegt bei @.
La valeur de @ est de @ unités.
El valor de @ es de @ unidades.
Copyright @ by @
Your code is @."""

SLOT_NAMES = "name|first name|user|title|date|amount|city|order id|product|price|value|year|sample|run|score|organism|author|company|email|start date|account number|item|text|unit|phone|address|total|id|subject|group|key|count|version|status|label|code|Customer|firstName|Order.Date|Full Name|user.name|itemCount".split("|")

#: Delimiters of slots: @ is the name as it is, _ with underscores, ^ in capitals with blanks, # in capitals with underscores.
SLOT_DELIMITERS = "{{_}}|{{ _ }}|{{@}}|{{{_}}}|${_}|#{_}|{%_%}|{% _ %}|<%= _ %>|<% _ %>|<?= $_ ?>|[[_]]|[[ @ ]]|«_»|« @ »|{_}|{ _ }|{$_}|[% _ %]|[#]|[^]|[INSERT ^]|[INSERT ^ HERE]|[YOUR ^]|[ENTER ^]|[Your @]|[insert @ here]|%#%|%%#%%|%(_)s|$#$|$_$|__#__|@@#@@|##_##|#_#|*|#|*|~_~|<_>|&lt;_&gt;|<<_>>|<your @>|<your @ here>|<insert @>|<enter @ here>|<@ goes here>|{!_!}|[[#]]|{#}|${#}|{{#}}|[%_%]|$(_)|${{_}}|{~_~}"

FORM_VALUES = "TODO|TBD|TBA|tbc|to be added|to be completed|to be determined|to be filled in|(fill in)|fill in here|???|XXX|xxxxx|[ ]|....|____|______|enter here|please enter|not filled in|n.n.|bitte ausfüllen|(Text einfügen)|wird ergänzt|noch offen|folgt noch|à remplir|à compléter|à définir|a completar|por completar|por definir|rellenar"

CONTRAST = {
    "en": """The engine expands {{ user }} when the mail is sent.
A placeholder in double braces, for example {{date}}, is replaced at run time.
The manual explains that <your name> must be replaced before printing.
Our letters use the placeholder [CITY], which the mail merge replaces with the town of the reader.
The format string '%(count)s rows' prints the number of rows.
In templates, a tag like <%= title %> writes the value of the variable title.
The macro @@VERSION@@ is expanded by the build tool.
A variable such as $HOME$ is expanded when the configuration is read.
The title pattern {author} - {title} gives the names of the files.
The tutorial shows how ${count} is interpolated into the string.
The syntax [[page]] marks a link to another page of the wiki.
The report generator looks for markers such as #TOTAL# and replaces them with numbers.
The template marks the customer with {{customer}} and the price with {{price}}.
To print the value of the field, write {field} in the format string.
As the manual says, the notation %s means that a string follows.
The renderer of the page reads the template and replaces every variable.
Every %NAME% in the batch file is substituted by its environment variable.
The docs explain how to escape braces such as {{ and }} in templates.
A slot like <<name>> in the contract stood for the tenant.
The template engine replaces {{title}} with the heading of the page.
Each placeholder such as {{name}} is filled from the row of the table.
Variables like ${user} are expanded by the shell before the command runs.
In older Python code a field of the row is inserted by '%(value)s' % row.
Use {{ variable }} to print a value in the template.
In the docs the notation <name> stands for any file name.
The marker [NAME] stood for the person to whom the letter was addressed.
The string %s is a format code and the program fills it with the argument.
The placeholder @@DATE@@ is replaced by the build script.
In this language a name in brackets, as in [[link]], makes a link.
The clerks wrote the day by hand over the field [DATE] of the old form.
File names follow the scheme {year}-{month}.txt in this folder.
At build time every variable of the page gets its value from the table.
Double braces mark a variable in many template languages.
Lorem ipsum is a dummy text that printers have used for centuries.
The designers filled the draft with lorem ipsum before the authors sent their chapters.
The words foo and bar are common names in programming examples.
Placeholder text helps designers to judge a layout before the real text is ready.
A 404 error means that the server found nothing at the address.
The server returned 503 Service Unavailable for an hour, and the job was run again at night.
When the download stopped with a timeout, we repeated it and all files were read.
The log shows that the connection was refused twice before it succeeded.
If the server returns 429 Too Many Requests, the client waits and tries again.
We handle the status 404 Not Found by skipping the record and counting it.
An error of two units occurred in the calibration and was corrected.
The page was not found in the archive, so the librarian ordered a copy.
Access was denied to guests until the new rules came into force in May.
JavaScript is a programming language used in most websites.
The chart is drawn by JavaScript code in the browser from numbers that the server sends.
Some visitors block scripts, and the site was built so that it works for them too.
Because the program requires JavaScript, its authors also offer a command line version.
We wrote a small script that converts the files and checks their sums.
The script reads each file and prints the number of its lines.
With scripts switched off, the menu opens as a plain list of links, which our test confirmed.
We tested the site with scripts turned off and it remained readable.""",
    "de": """Eine Vorlage enthält Variablen wie {{name}}, die beim Versand ihre Werte erhalten.
Das Handbuch erklärt, dass ${pfad} beim Start ersetzt wird.
In der Vorlage steht %NAME% für den Namen des Kunden und wird beim Druck ersetzt.
Der Platzhalter [DATUM] wurde im Formular durch das Datum ersetzt.
Variablen wie ${user} werden von der Shell ersetzt.
Die Gestalter füllten den Entwurf mit Blindtext, bevor die Kapitel eintrafen.
Ein Fehler 404 bedeutet, dass der Server nichts gefunden hat.
Der Server meldete eine Stunde lang 503, und der Auftrag lief nachts noch einmal.
Das Diagramm wird im Browser von JavaScript aus den Zahlen des Servers gezeichnet.
Manche Besucher sperren Skripte, und die Seite wurde auch für sie gebaut.
Das Skript liest alle Dateien und zählt ihre Zeilen.""",
    "fr": """Un modèle contient des variables comme {{name}}, qui reçoivent leur valeur à l’envoi.
Le manuel explique que ${chemin} est remplacé au démarrage.
Dans le gabarit, %NOM% désigne le nom du client et est remplacé à l’impression.
Le champ [DATE] de l’ancien formulaire était remplacé à la main.
Les variables comme ${user} sont remplacées par le shell.
Les graphistes ont rempli la maquette de faux texte avant l’arrivée des chapitres.
Une erreur 404 signifie que le serveur n’a rien trouvé.
Le serveur a renvoyé 503 pendant une heure, et la tâche a été relancée la nuit.
Le graphique est dessiné dans le navigateur par JavaScript à partir des nombres du serveur.
Certains visiteurs bloquent les scripts, et le site a été conçu aussi pour eux.
Le script lit tous les fichiers et compte leurs lignes.""",
    "es": """Una plantilla contiene variables como {{name}}, que reciben su valor al enviarse.
El manual explica que ${ruta} se sustituye al arrancar.
En la plantilla, %NOMBRE% es el nombre del cliente y se sustituye al imprimir.
El campo [FECHA] del antiguo formulario se sustituía a mano.
Las variables como ${user} las sustituye el intérprete.
Los diseñadores llenaron el borrador con texto de relleno antes de recibir los capítulos.
Un error 404 significa que el servidor no encontró nada.
El servidor devolvió 503 durante una hora, y la tarea se repitió por la noche.
El gráfico lo dibuja JavaScript en el navegador con los números del servidor.
Algunos visitantes bloquean los scripts, y el sitio se hizo también para ellos.
El script lee todos los archivos y cuenta sus líneas.""",
    "code": """print("value of %s" % total)
print(f"{item.name}: {item.value:.2f}")
print("{} of {}".format(done, total))
for row in reader(f"{folder}/data.csv"):
path = f"/data/{year}/{month}.csv"
query = "SELECT %s FROM %s WHERE id = %d" % (column, table, key)
assert result == {"a": 1, "b": [2, 3]}, result
const label = `${count} rows`;
echo "${HOME}/bin" >> $PATH
cp ${SRC}/*.txt ${DST}
if [[ -n $name ]]; then echo "$name"; fi
logger.info("read %(n)d rows", {"n": n})
def mass(self, **kwargs): return {k: v for k, v in kwargs.items()}
<a href="page.html">link</a> <b>bold</b> <div class="x">
matrix[[0, 1], [2, 3]] = values[i][j]
__init__(self, name=None) and __name__ == "__main__"
[M+H]+ ions and [M+2H]2+ ions were seen
PEPT[+79.966]IDE and EM[Oxidation]EVT{Glycan:Hex}SES-[Amidated]
<[+57.02]@C>ATPEILTCNSIGCLK [Acetyl]-QYK
x = {"key": [1, 2], 'other': {3}}
<p class="note">one <em>word</em> in a <b>line</b></p> <br/>
<i>in vitro</i> and <b>in vivo</b>, H<sub>2</sub>O and 10<sup>3</sup>
<|endoftext|> <|im_start|> <s> </s> [CLS] [SEP] [MASK] <pad> <unk>""",
}


def _lines(groups: dict[str, str]) -> dict[str, list[str]]:
    return {lang: text.split("\n") for lang, text in groups.items()}


def slots(delimiter: str, names: list[str]) -> list[str]:
    """The names between one pair of delimiters."""
    out = []
    for n in names:
        snake = n.replace(" ", "_")
        if "@" in delimiter.replace("@@", ""):
            out.append(delimiter.replace("@", n))
        elif "^" in delimiter:
            out.append(delimiter.replace("^", n.upper()))
        elif "_" in delimiter.replace("__", ""):
            out.append(delimiter.replace("_", snake))
        else:
            at = delimiter.index("#", len(delimiter) // 2 - 1) if delimiter.count("#") > 1 else delimiter.index("#")
            out.append(delimiter[:at] + snake.upper() + delimiter[at + 1 :])
    return out


def delimiters() -> list[str]:
    """SLOT_DELIMITERS one by one; a bar that belongs to a pair of delimiters ('*|#|*') stays with it."""
    text = SLOT_DELIMITERS.replace("*|#|*", "*\0#\0*")
    return [d.replace("\0", "|") for d in text.split("|")]


def slot_lines() -> dict[str, list[str]]:
    """Slots by pair of delimiters, alone and in sentences, and unfilled form fields (kind 'form')."""
    frames = SLOT_FRAMES.split("\n")
    out = {}
    for d in delimiters():
        filled = slots(d, SLOT_NAMES)
        around = itertools.cycle(filled)
        lines = list(filled)
        for f in frames:
            while "@" in f:
                f = f.replace("@", next(around).replace("@", "\1"), 1)
            lines.append(f.replace("\1", "@"))
        out[d] = lines
    out["form"] = [f"{n.capitalize()}: {v}" for n in SLOT_NAMES for v in FORM_VALUES.split("|")]
    return out


def examples() -> dict[str, dict[str, list[str]]]:
    """kind -> language (delimiters for slots) -> lines."""
    return {"slot": slot_lines(), "filler": _lines(FILLER), "error": _lines(ERROR), "script": _lines(SCRIPT), "contrast": _lines(CONTRAST)}
