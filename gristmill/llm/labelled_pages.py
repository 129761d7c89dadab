"""Small labelled tables written for this library, from which the weights of page lines are fitted.

Lines of page furniture and of main text in five languages, invented; ``pages`` puts them
together, by a seeded choice, to pages whose every line is labelled. ``{s}`` is the name of
the site, ``{a}`` and ``{b}`` are made-up words.
"""
from __future__ import annotations

import random

#: Entries of menus.
MENU = """
Home|Homepage|Start|About|About us|Our story|Who we are|Our team|Contact|Contact us|Get in touch|Find us|News|Newsroom|Press|Blog|Journal|Magazine|Articles|Forum|Community|Members|Groups|Messages|Notifications|Search|Advanced search|Browse|Categories|Topics|Tags|Archive|Archives|Gallery|Photos|Videos|Podcast|Downloads|Events|Calendar|Shop|Store|Products|Services|Pricing|Plans|Basket|Cart|Cart (2)|Bag (0)|Checkout|Wishlist|Orders|My orders|My account|Account|Profile|Settings|Preferences|Log in|Login|Log out|Logout|Sign in|Sign out|Sign up|Register|Join|Join now|Create account|Forgot password?|Help|Help centre|Support|FAQ|Customer service|Feedback|Jobs|Careers|Vacancies|Advertise|Partners|Affiliates|Donate|Support us|Volunteer|Newsletter|Subscribe|Subscriptions|RSS|Sitemap|Site map|Terms|Terms of service|Privacy|Privacy policy|Cookie policy|Legal|Legal notice|Imprint|Disclaimer|Accessibility|Weather|Sport|Sports|Business|Politics|Culture|Science|Health|Travel|Opinion|Local|World|Recipes|Reviews|Menu|Close|Close menu|More|Language|English|Skip to main content|Skip navigation|Open navigation|Back|Next|Previous|Print|Share|Save
Startseite|Start|Über uns|Wir über uns|Team|Kontakt|Aktuelles|Nachrichten|Neuigkeiten|Magazin|Forum|Mitglieder|Suche|Suchen|Archiv|Galerie|Bilder|Termine|Veranstaltungen|Laden|Geschäft|Produkte|Leistungen|Preise|Warenkorb|Warenkorb (1)|Kasse|Merkzettel|Bestellungen|Mein Konto|Konto|Profil|Einstellungen|Anmelden|Einloggen|Abmelden|Registrieren|Passwort vergessen?|Hilfe|Kundendienst|Häufige Fragen|Stellen|Stellenangebote|Karriere|Werbung|Partner|Spenden|Mitmachen|Rundbrief|Abonnieren|Impressum|Datenschutz|Nutzungsbedingungen|AGB|Barrierefreiheit|Wetter|Sport|Politik|Kultur|Wissen|Reise|Menü|Schließen|Mehr|Zum Hauptinhalt|Navigation überspringen|Zurück|Weiter|Drucken|Teilen
Accueil|À propos|Qui sommes-nous|Notre équipe|Contact|Contactez-nous|Actualités|Presse|Journal|Forum|Membres|Recherche|Rechercher|Archives|Galerie|Photos|Agenda|Événements|Boutique|Magasin|Produits|Services|Tarifs|Panier|Panier (1)|Commandes|Mon compte|Compte|Profil|Paramètres|Connexion|Se connecter|Déconnexion|S'inscrire|Inscription|Mot de passe oublié ?|Aide|Assistance|Questions fréquentes|Emplois|Recrutement|Publicité|Partenaires|Dons|Faire un don|Lettre d'information|S'abonner|Mentions légales|Confidentialité|Conditions d'utilisation|Accessibilité|Plan du site|Météo|Sport|Politique|Culture|Santé|Voyages|Menu|Fermer|Plus|Aller au menu|Retour|Suivant|Imprimer|Partager
Inicio|Portada|Quiénes somos|Sobre nosotros|Nuestro equipo|Contacto|Contáctenos|Noticias|Prensa|Revista|Foro|Miembros|Buscar|Búsqueda|Archivo|Galería|Fotos|Agenda|Eventos|Tienda|Productos|Servicios|Precios|Cesta|Carrito (1)|Pedidos|Mi cuenta|Cuenta|Perfil|Ajustes|Entrar|Iniciar sesión|Cerrar sesión|Registrarse|Regístrese|¿Olvidó su contraseña?|Ayuda|Atención al cliente|Preguntas frecuentes|Empleo|Trabaja con nosotros|Publicidad|Socios|Donar|Donaciones|Boletín|Suscribirse|Aviso legal|Privacidad|Condiciones de uso|Accesibilidad|Mapa del sitio|El tiempo|Deportes|Política|Cultura|Salud|Viajes|Menú|Cerrar|Más|Ir al menú|Volver|Siguiente|Imprimir|Compartir
首页|主页|关于我们|关于本站|团队|联系我们|联系方式|新闻|资讯|新闻中心|杂志|论坛|社区|会员|搜索|高级搜索|归档|图库|图片|视频|活动|日历|商店|商城|产品|服务|价格|购物车|订单|我的订单|我的账户|账户|个人中心|设置|登录|退出|注册|忘记密码|帮助|帮助中心|客服|常见问题|招聘|人才招聘|广告服务|合作伙伴|捐助|订阅|使用条款|隐私政策|免责声明|网站地图|天气|体育|财经|文化|健康|旅游|菜单|关闭|更多|跳至内容|返回|下一页|打印|分享
""".strip().split("\n")

#: Notices, bars and footers.
NOTICE = """
This website uses cookies to give you the best experience. Accept | Decline
We and our partners store and access information on your device, such as cookies.
Our website places cookies so that we can count visits and show adverts that suit you.
We use necessary cookies to make our site work. Accept all cookies | Manage preferences
By continuing to use this website you consent to the use of cookies.
By closing this banner or scrolling the page you accept our cookie policy.
{s} uses cookies and similar techniques. You can change your choice at any time.
{s} would like to send you notifications. Allow | Not now
{s} asks for your consent to use your personal data. Agree | Options
Choose which cookies you allow {s} to set. Confirm my choices
Cookie settings: Reject all | Accept all | Save
We value your privacy. Read our privacy statement for details.
Manage consent
Okay, close
Got it, thanks
I understand
OK
OK, understood
Loading more
Loading your page
Please wait…
View basket
Add to basket
Jump to content
Jump to navigation
Toggle the sidebar
Expand menu
Language: English | Deutsch
Available in: English, Deutsch, Français
Share this: Chatter, Facepage, Mail
Allow all | Only necessary
I agree
By choosing Accept you allow {s} to measure the use of its pages.
Accept and continue
Understood
Dismiss
JavaScript is turned off in your browser. Please enable it to view {s} properly.
Your browser is out of date. Update it to use all functions of {s}.
{s} works best with scripts enabled.
Turn off your ad blocker to continue reading {s}.
You have read your last free story this month. Subscribe to keep reading {s}.
Already a subscriber? Log in here
Create a free account to read on.
Register for free to continue. It takes a minute.
This story is for subscribers of {s} only.
Sign up for our weekly newsletter and never miss a story
Get the latest from {s} delivered to your inbox.
Enter your email address to subscribe.
Your email address   Subscribe
Join 12,000 readers of our newsletter
Unsubscribe at any time.
Follow {s} on Chatter, Picfeed and Vidtube
Find us on Facepage | Chatter | Picfeed
Like us on Facepage
Share on Chatter
Share this article: Facepage Chatter Email
Share via email | Copy link | Print page
Tweet   Share   Pin   Mail
Send to a friend
Save for later
Email this page | Print this page
4 shares   18 comments
Add a comment
Leave a comment
Leave a reply
Post a comment
You must be logged in to post a comment.
Sign in or register to leave a reply
Create your account and join the discussion
Have your say: log in first
Members can log in here to comment
Write to us with your comments about this site
Please log in or register to comment.
Comments are closed.
No comments yet. Be the first to comment.
3 comments   Add yours
View comments (14)
Report this comment
Reply   Like   Report
Sort by: newest | oldest
Page 2 of 14
Older posts | Newer posts
« Previous   Next »
← Older entries   Newer entries →
Previous article: The {a}
Next: More about {a}
Continue reading →
Read more »
Read full article
See all
Show more
View all articles
Load more stories
Back to top ↑
Go to top
Return to homepage
Return to search results
Scroll to top
Advertisement
Advertisement - continue reading below
Advert
Ad
Paid content
Promoted
Partner content
Sponsored by {s}
Story continues after the advert
Home > {a} > {b}
Home / {a} / {b}
Home › News › {a}
You are here: Home / {a}
Filed under: {a}, {b}
Posted in {a} | Tagged {b}
Tagged with: {a}, {b}
Categories: {a}, {b}
Topics: {a} · {b}
Tags: {a}, {b}
Choose your language: English | Deutsch | Français | Español
Change country or language
Select your region
Switch to mobile site
View desktop version
Download the {s} app
Get our app for free
Available in the app stores
Search this site
Search for:
Search {s}
Toggle search
Toggle menu
Open main menu
Close this window
Loading, please wait
Loading comments...
Skip to footer
Text size: A A A
Copyright © 2021 {s}. All rights reserved.
© 2019 {s}
{s} 2020
{s} 2023
© 2022 {s} Ltd. All rights reserved worldwide.
(c) 2018-2023 {s} and its licensors
Copyright {s} 2020 | Legal notice | Contact
© {s}. Unauthorised copying is prohibited.
No part of this site may be reproduced without written permission of {s}.
All texts and pictures are the property of {s}. Reproduction prohibited.
The content of this website belongs to {s} and may not be copied.
Powered by Sitewright
Proudly powered by Blogsmith
Website by Kestrel Design
Theme: Harbour by Blogsmith
Built with Sitewright
Hosted by Northcloud
Terms and conditions | Privacy notice | Cookies | Contact
Privacy policy · Terms of service · Imprint
About this site | Advertise | Careers | Help
Site map | Report an error on this page | Accessibility statement
Last updated by the web editor | Print
Contact our web editor about this page
Was this page helpful? Yes | No
Rate this page
Basket (0) | Checkout
Your basket is empty
Free delivery on orders over 40 | Track my order
Follow us
Stay connected
Connect with us
Quick links
Useful links
Site navigation
Main menu
Wir setzen Cookies ein, damit unsere Webseite gut funktioniert. Zustimmen | Ablehnen
Unsere Webseite verwendet Cookies. Weitere Hinweise finden Sie in der Datenschutzerklärung.
Wenn Sie weitersurfen, erklären Sie sich mit der Verwendung von Cookies einverstanden.
{s} möchte Cookies speichern. Alle akzeptieren | Nur notwendige
{s} bittet um Ihre Einwilligung in die Verarbeitung Ihrer Daten.
Cookie-Einstellungen: Alle ablehnen | Auswahl speichern
Bitte aktivieren Sie JavaScript in Ihrem Browser, um {s} vollständig zu nutzen.
Um Ihnen den Besuch angenehmer zu machen, verwenden wir Cookies. Annehmen | Einstellungen
Schalten Sie bitte JavaScript ein, damit {s} richtig angezeigt wird.
Einverstanden
Ich habe verstanden
Direkt zum Inhalt
Zur Navigation springen
Wird geladen…
Wieder nach oben
Seite erstellt von Kestrel Design
Auf dieser Webseite werden Cookies gespeichert.
Menü öffnen
Akzeptieren und schließen
Melden Sie sich an, um weiterzulesen.
Abonnieren Sie den Newsletter von {s}
Jetzt kostenlos registrieren
Folgen Sie uns auf Chatter
Beitrag teilen | Seite drucken | Link kopieren
Diesen Artikel weiterempfehlen
Kommentar schreiben
Registrieren Sie sich bitte, um Beiträge zu schreiben.
Nur angemeldete Benutzer können Kommentare schreiben.
Melden Sie sich hier an, um mitzureden
Bestellen Sie unseren kostenlosen Rundbrief
Bitte einloggen, um zu kommentieren.
Noch keine Kommentare
Alle Kommentare anzeigen
Vorheriger Beitrag | Nächster Beitrag
Weiterlesen »
Mehr anzeigen
Zum Seitenanfang
Zurück zur Übersicht
Werbung
Anzeige
Sie befinden sich hier: Start > {a}
Sie sind hier: Home / {a} / {b}
Schlagwörter: {a}, {b}
© 2021 {s}. Alle Rechte vorbehalten.
Copyright 2020 {s} | Impressum | Datenschutzerklärung
Alle Inhalte sind Eigentum von {s}. Nachdruck nur mit Genehmigung.
Umgesetzt mit Sitewright
Bereitgestellt von Blogsmith
Impressum | Datenschutzerklärung | Cookie-Einstellungen
Ce site utilise des cookies afin d'améliorer la navigation. Accepter | Refuser
En continuant votre navigation, vous acceptez l'utilisation de cookies.
{s} et ses partenaires déposent des cookies sur votre appareil. Tout refuser | Personnaliser
{s} souhaite obtenir votre consentement. J'accepte | Gérer mes choix
Veuillez activer JavaScript dans votre navigateur pour profiter de {s}.
Tout accepter
D'accord
J'ai bien compris
Aller directement au contenu principal
Sauter la navigation
Chargement…
Remonter en haut de page
Des cookies sont enregistrés sur ce site.
Abonnez-vous à la lettre d'information de {s}
Connectez-vous pour lire la suite.
Suivez-nous sur Chatter
Partager cet article | Imprimer cette page
Envoyer à un ami
Laisser un commentaire
Inscrivez-vous pour laisser un message
Recevez gratuitement notre lettre d'information
Seuls les membres peuvent écrire un commentaire.
Connectez-vous pour commenter.
Aucun commentaire
Article précédent | Article suivant
Lire la suite »
Voir plus
Retour en haut
Publicité
Contenu sponsorisé
Vous êtes ici : Accueil > {a}
Mots-clés : {a}, {b}
© 2021 {s}. Tous droits réservés.
Tous les contenus appartiennent à {s}. Reproduction interdite sans autorisation.
Site réalisé avec Sitewright
Propulsé par Blogsmith
Mentions légales | Politique de confidentialité | Gestion des cookies
Este sitio web utiliza cookies para ofrecerle una mejor experiencia. Aceptar | Rechazar
Si continúa navegando, acepta el uso de cookies.
{s} y sus socios guardan cookies en su dispositivo. Aceptar todas | Configurar
{s} solicita su consentimiento. Acepto | Más opciones
Active JavaScript en su navegador para usar {s}.
Aceptar y cerrar
De acuerdo
Entendido, gracias
Ir directamente al contenido principal
Saltar la navegación
Cargando…
Ir arriba
Esta página guarda cookies.
Suscríbase al boletín de {s}
Inicie sesión para seguir leyendo.
Síganos en Chatter
Compartir este artículo | Imprimir esta página
Enviar a un amigo
Deje un comentario
Regístrese gratis para escribir un comentario
Reciba gratis nuestro boletín en su correo
Suscríbase a nuestras noticias
Solo los usuarios registrados pueden comentar.
Inicie sesión para comentar.
No hay comentarios
Artículo anterior | Artículo siguiente
Leer más »
Ver más
Volver al principio
Publicidad
Contenido patrocinado
Está usted en: Inicio > {a}
Etiquetas: {a}, {b}
© 2021 {s}. Todos los derechos reservados.
Todos los contenidos son propiedad de {s}. Prohibida su reproducción.
Creado con Sitewright
Desarrollado con Blogsmith
Aviso legal | Política de privacidad | Política de cookies
我们使用Cookie来提升您的体验。 接受 | 拒绝
继续使用本网站即表示您接受我们的Cookie政策。
本站使用Cookie收集统计信息。 全部接受 | 管理
请在浏览器中启用JavaScript以正常使用{s}。
同意并继续
我已了解
我知道了，关闭
跳到导航
正在加载
使用本网站即表示同意隐私条款。
订阅我们的电子报
登录后继续阅读
关注我们的微信公众号
分享到： 微博 微信 朋友圈
转发 收藏 打印本页
发表评论
请登录后发表评论
暂无评论
查看全部评论
上一篇 | 下一篇
阅读全文 »
加载更多
回到顶部
广告
赞助内容
当前位置：首页 > 新闻 > {a}
标签：{a} {b}
版权所有 © 2021 {s} 保留所有权利
本站所有内容归{s}所有，未经许可不得转载。
技术支持：织网建站
关于本站 | 服务条款 | 隐私声明 | 联系我们
""".strip().split("\n")

#: Headings of lists of other articles; what follows them is furniture, too.
LIST_HEADINGS = """
Related|Related content|Related reading|Related stories|More like this|You may like|Also in this section|More in this series|More on this topic|More from {s}|More news|More articles|Keep reading|Read next|Up next|Don't miss|Editor's picks|Top stories|Popular|Popular posts|Popular now|Most popular|Most viewed|Most shared|Most commented|Recommended|Recommended reading|We recommend|Suggested articles|Latest|Latest articles|Latest posts|Latest stories|Recent articles|Recent comments|Recently added|Other articles|See also these stories|You might also like|You might be interested in|Readers also viewed|Also on {s}|Elsewhere on {s}|Trending|Trending stories|This week's favourites|From the archive
Mehr zum Thema|Ähnliche Artikel|Weitere Artikel|Weitere Beiträge|Verwandte Artikel|Auch interessant|Lesen Sie auch|Neueste Artikel|Letzte Beiträge|Beliebte Beiträge|Meistgelesene Artikel|Empfehlungen|Aus dem Archiv|Das könnte Sie interessieren|Mehr von {s}
Sur le même sujet|Autres articles|Articles similaires|Articles récents|Derniers articles|Articles les plus lus|À lire aussi sur {s}|À lire également|Vous aimerez aussi|Nos recommandations|À ne pas manquer
Noticias relacionadas|Otros artículos|Artículos similares|Artículos recientes|Últimas noticias|Últimos artículos|Los más leídos|Más leídas|Lea también|También en {s}|Le puede interesar|Recomendados|No se lo pierda
相关阅读|相关新闻|相关推荐|延伸阅读|猜你喜欢|热门文章|热门新闻|最新资讯|最新发布|编辑推荐|更多文章|其他文章
""".strip().split("\n")

#: Sentences of main text.
BODY = """
The mill was closed for three years before a family from the next valley bought it.
She measured the beam twice, wrote the numbers on her sleeve and cut the wood without another look.
Nobody could say when the first swallows had come back, but the barn was full of them by May.
A thin layer of sand lies below the clay, and water runs through it even in dry summers.
We met at the old station, where the clock had stopped at ten past four.
If the dough does not rise, leave it near the stove for another hour.
In 1874 the council voted to build a second bridge, and two years later the work began.
Most of the visitors stay for one night only; those who stay longer walk to the lake.
He asked whether the letter had arrived, and I told him that it had not.
The results of the survey were published in the autumn and surprised everyone in the village.
There is no simple answer to that, said the keeper, and went on feeding the geese.
Turn the key slowly until you hear a click, then lift the lid with both hands.
Because the road was flooded, the doctor came by boat.
What makes this lamp so useful is its weight, which keeps it still in a storm.
The price of wool fell again last winter, so many farmers sold half of their sheep.
My grandmother kept bees, and her neighbours came from far away to buy the honey.
Only after the second trial did the engineers agree on the shape of the wheel.
Some people think that the tower leans, although it is the hill behind it that does.
Put the seeds in a warm place, water them every morning and wait for two weeks.
It was hard to see the harbour through the fog, and harder to hear the bell.
They have argued about the fence for years, but neither wants to go to court.
Light travels through glass more slowly than through air, which is why lenses work.
You should never leave the gate open when the dogs are in the yard.
The committee will meet again in March to decide about the new library.
Our class planted forty trees on the slope, and thirty of them are still alive.
The cookies were baked by the pupils and sold for the new roof of the gym.
All visitors may use the back door until the repairs are finished, the manager said.
Please write to the town hall if you want to speak at the meeting.
Anyone who wants to help can come to the boathouse on Saturday with gloves and a spade.
Members of the choir share a car to the rehearsals and share the costs as well.
The search for the missing boat went on all night and was called off at dawn.
She signed in at the desk, took the stairs and found the office empty.
The rights of the fishermen to the north shore were confirmed by the king in 1511.
I read his comment about the roof with care and I still do not agree with it.
The privacy of the nuns was protected by a wall four metres high.
The newspaper printed her reply on the next page, under a picture of the dam.
He subscribed to the theory that the stones had been moved by ice.
The account of the journey fills three notebooks, which the museum has on loan.
They followed us for a mile, then turned back to the farm.
Nothing was reserved for late guests, so we ate bread and cheese on the steps.
Do you accept that the map is wrong, or shall we measure the field again?
If you like, you can help us to carry the chairs into the hall.
Der Müller verkaufte das Haus, weil der Bach im Sommer kein Wasser mehr führte.
Sie fragte den Lehrer, ob das Buch noch zu haben sei, und bekam keine Antwort.
Im Herbst wird das Dach erneuert, danach ziehen die Kinder in den ersten Stock.
Wer den Turm besteigen will, muss sich beim Küster den Schlüssel holen.
Niemand hatte damit gerechnet, dass der Winter so lange dauern würde.
Nach dem Regen war die Straße glatt, und zwei Wagen rutschten in den Graben.
Die Suche nach dem Hund dauerte bis zum Abend, dann kam er von selbst zurück.
Alle Rechte an dem Wald liegen seit Jahren bei der Gemeinde, sagte der Förster.
Man kann das Brot auch ohne Hefe backen, es wird dann aber flacher.
Er hat den Brief geschrieben, aber nie abgeschickt.
Bitte kommen Sie pünktlich, denn der Zug wartet nicht auf die Gruppe.
Le boulanger a fermé sa porte plus tôt que d'habitude, car il neigeait depuis midi.
Personne ne sait pourquoi la cloche a sonné deux fois cette nuit-là.
Il faut laisser reposer la pâte pendant une heure avant de la couper.
Les enfants ont traversé le pont en courant et se sont cachés derrière le moulin.
Au printemps, la rivière monte et les barques ne passent plus sous l'arche.
Elle a demandé à voir la lettre, mais on lui a répondu qu'elle était perdue.
Si vous continuez par ce chemin, vous arriverez au lac avant la nuit.
Tous les habitants ont droit à une part de bois, dit le maire.
Pour toute question sur les chevaux, demandez au gardien.
El panadero abrió la puerta antes del alba porque esperaba la harina.
Nadie supo decir cuándo se había cerrado la mina, pero fue hace mucho.
Hay que dejar la masa en un lugar cálido durante una hora.
Los niños cruzaron el puente y se escondieron detrás del molino.
En primavera el río sube y las barcas no pasan por debajo del arco.
Preguntó por la carta y le dijeron que se había perdido en el camino.
Si usted sigue por este camino, llegará al lago antes de la noche.
Todos los vecinos tienen derecho a una parte de la leña, dijo el alcalde.
La búsqueda del barco duró toda la noche y terminó al amanecer.
老渔夫说，今年的鱼比去年少了一半，所以他想把船卖掉。
下雨以后，山路很滑，孩子们只好在庙里等到天黑。
这座桥是一百多年前修建的，现在仍然有人每天从上面走过。
她把信放在桌子上，没有说一句话就走了。
如果面团没有发起来，就再等一个小时。
没有人知道钟为什么在那天夜里响了两次。
图书馆下个月重新开放，读者可以从后门进去。
他们讨论了很久，最后决定把旧房子留给学校。
""".strip().split("\n")

#: Lines of main text that are no sentences: headings, items, rows, signatures.
LOOSE = """
Why the mill was closed|A short walk around the lake|The keeper of the bees|Notes on the second bridge|How we built the boathouse|Winter in the valley|What the survey found|The Quiet Years Of The Harbour|Lamp And Lens In Stormy Places|On the weight of bells|Ingredients|Method|Introduction|Results|Background|First steps|Equipment|Part two: the crossing|Chapter 4|Summary|Der Turm am Bach|Ein Haus ohne Dach|Zutaten|Die Brücke – ein Rückblick|Le moulin sous la neige|La barque et le pont|Ingrédients|El molino y el río|La campana – apuntes|老渔夫的船|山路上的庙|做面包的方法
200 g butter|3 eggs|1 tbsp of brown sugar|2 large onions, chopped|150 ml milk|12 nails, 40 mm|- a sharp knife and a board|- two ropes of equal length|* dried apples, 500 g|1. Sand the plank on both sides|2. Paint it twice|3) Let it dry overnight|Step 2: tighten the screws|o warm socks and a lamp|► leise Stimmen im Hof
Name;Age;Town|Anna;31;Ostby|mill | stone | 1874 | open|height | 12 m | oak|Bolt ......... 2.40|Lamp oil ....... 7.95|07:15 Ostby  08:02 Lakeside  09:40 Hill|Mon 9-12, Tue closed, Wed 9-17|Plum: a small dark fruit|Gable: the end wall of a roof|Version 2.4.1: fixed the pump timer|2021-03-04 10:22:11 WARN pump idle for 40 s|if (level > 3) { open(valve); }|return sum / n;|drwxr-xr-x 2 anna mill 4096|0.33 1.87 12.5 9.04|14.2, 15.9, 3.3, 8.0, 7.7|9f8a77c01b22e4|B. Okoro, Building with clay, 1998, p. 41|[3] Lind, A.: On lamps. Ostby 2004|RED LAMP / OLD ROPE / THIN OAR / WET BOOT|oak plank, pine plank, ash plank, elm plank
Kind regards|Yours sincerely|Anna Lindqvist|Mit freundlichen Grüßen|Cordialement|Saludos|Tel. 0555 0142|Question: how deep is the lake?|Answer: nobody has measured it|Really?|Not at all!|No.|Ouch|until the next spring|but only in the morning
""".strip().split("\n")

def harmless() -> list[str]:
    """All lines of the tables, for models that must not mistake them for something else."""
    out = [x for rows in (MENU, LIST_HEADINGS, LOOSE) for row in rows for x in row.split("|")] + NOTICE + BODY
    return [x.replace("{s}", "Northgate").replace("{a}", "bridges").replace("{b}", "lamps") for x in out]


_SYLLABLES = "ba do fen gar hul lim mor nes ost pel rin sol tam ver wick yar zel bran cor dal".split()


def word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 3)))


def pages(seed: int = 7, n: int = 700) -> list[tuple[str | None, list[tuple[str, bool]]]]:
    """``(address, lines)`` of ``n`` pages, every line with whether it belongs to the main body; blank lines do."""
    r = random.Random(seed)
    menus, loose, heads = [m.split("|") for m in MENU], [x for row in LOOSE for x in row.split("|")], [h.split("|") for h in LIST_HEADINGS]
    out = []
    for _ in range(n):
        name = " ".join(word(r).title() for _ in range(r.randint(1, 2)))
        lang = r.choice([0, 0, 0, 0, 1, 2, 3, 4])
        fill = lambda t: t.replace("{s}", name).replace("{a}", word(r).title()).replace("{b}", word(r).title())  # noqa: E731, B023

        def labels(k: int) -> list[str]:
            """Entries of a menu, some or most of them of the site's own."""
            own = max(r.randint(0, k - 1), r.randint(0, k - 1)) if r.random() < 0.6 else 0
            out = [r.choice(["", "", "", "New ", "More "]) + word(r).title() + r.choice(["s", "", "", " room", " & more", " news"]) for _ in range(own)] + r.sample(menus[lang], k - own)  # noqa: B023
            r.shuffle(out)
            return out

        def menu() -> list[str]:
            if r.random() < 0.45:
                return labels(r.randint(3, 9))
            return [r.choice([" | ", " » ", " · ", " / ", "   ", " > ", " - "]).join(labels(r.randint(3, 9)))]

        def notice() -> list[str]:
            return [fill(r.choice(NOTICE))]  # noqa: B023

        def others() -> list[str]:
            mark = r.choice(["", "", "> ", "- ", "• "])
            items = [r.choice(loose[:30]) if r.random() < 0.5 else f"{word(r)} and {word(r)} in {word(r)}".capitalize() for _ in range(r.randint(2, 5))]
            return [fill(r.choice(heads[lang])), *[mark + x for x in items]]  # noqa: B023

        def items() -> list[str]:
            """The lines of a page that is a list: things, entries, rows, titles."""
            w = lambda: word(r)
            kind = r.choice([
                lambda: f"{w()} {w()}", lambda: f"{w()} {w()} {r.randint(2, 90)} cm", lambda: f"{w().title()}: {w()} {w()}", lambda: f"{w().title()} {w().title()} {w().title()}", lambda: f"{w().title()} {w()} {r.randint(1980, 2030)}",
                lambda: f"{w()} {w()} and {w()}", lambda: f"{w()} | {w()} | {r.randint(1, 99)} | {w()}", lambda: " / ".join(f"{w()} {w()}".upper() for _ in range(r.randint(2, 5))), lambda: f"{r.randint(1, 900)} g {w()}", lambda: f"{w().title()} {w().title()}, {w()}@{w()}.example",
                lambda: f"{w()} {w()}: £{r.randint(1, 900)}.{r.randint(10, 99)} {r.choice(['Add to basket', 'sold out', ''])}", lambda: f"What the {w()} {w()}s", lambda: f"{w()}   {w()}   {r.randint(2, 90)}   {w()}", lambda: f"{w()} {r.choice(['in', 'of', 'with'])} {w()}",
            ])
            mark = r.choice(["", "", "", "- ", "* ", "o "])
            return [mark + kind() for _ in range(r.randint(3, 25))]

        def body() -> list[str]:
            kind = r.random()
            if kind < 0.2:
                return items()
            if kind < 0.6:
                return [" ".join(r.sample(BODY, r.randint(1, 6)))]
            if kind < 0.7:
                return r.sample(BODY, r.randint(1, 3))
            if kind < 0.82:
                row = r.choice([x.split("|") for x in LOOSE[1:3]])
                return [r.choice(row) for _ in range(r.randint(1, 6))]
            if kind < 0.95:  # a paragraph in short lines
                ws = " ".join(r.sample(BODY, 4)).split()
                k = r.randint(6, 13)
                return [" ".join(ws[i : i + k]) for i in range(0, len(ws), k)]
            return [r.choice(loose)]

        lines: list[tuple[str, bool]] = []
        gap = r.random() < 0.6

        def put(block: list[str], good: bool) -> None:
            lines.extend((x, good) for x in block)  # noqa: B023
            if gap or r.random() < 0.3:  # noqa: B023
                lines.append(("", True))  # noqa: B023

        for part in r.sample([menu, notice, notice, lambda: [name], menu], r.randint(0, 4)):
            put(part(), False)
        if r.random() < 0.8:
            put([r.choice(loose[:30]) if r.random() < 0.6 else f"{word(r)} {r.choice(['in', 'and', 'of'])} {word(r)}".title()], True)
        for _ in range(r.randint(1, 6)):
            put(body(), True)
            if r.random() < 0.15:
                put(r.choice([notice, menu, others])(), False)
        for part in r.sample([menu, notice, notice, notice, others], r.randint(0, 4)):
            put(part(), False)
        out.append((f"https://www.{name.lower().replace(' ', '-')}.example/{word(r)}" if r.random() < 0.8 else None, lines))
    return out
