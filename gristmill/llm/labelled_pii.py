"""A small labelled table of sentences with personal information, written for this library.

Rows come from templates with slots; a slot is filled with invented values of its type, so
the table is built from this rule rather than listed. All values are invented: hosts end
in reserved names and numbers come from ranges that are not issued.
"""
from __future__ import annotations

import random
import re

from gristmill.llm import labelled_pages

#: Common given names.
GIVEN = frozenset(
    "Victor Simon Karim Ayumi Felix Kofi Peter Monika Rosa Sofia Clara David Helen Julia Laura Fatima Paul Irene Tomas Samuel Yusuf Bogdan Leon Chen Amara Priya Ines Elena Emil Jonas Alice Adrian Mei Nora Maria Martin Greta Teresa Milan Olena Ravi Oscar Edith Walter Robert Hugo Lena Anna John James William Thomas Michael Richard Charles Joseph George Edward Henry Daniel Andrew Mark Steven Kevin Brian Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emma Olivia Sophie Lucy Grace Hannah Hans Klaus Jürgen Stefan Wolfgang Andreas Markus Sabine Petra Ursula Claudia Katrin Heike Anja Pierre Jean Michel Jacques Claude Philippe Marie Isabelle Nathalie Camille José Carlos Juan Luis Miguel Antonio Javier Carmen Ana Isabel Lucía Pilar Elisa Ivan Dmitri Olga Natalia Ahmed Mohammed Omar Ali Aisha Layla Wei Ming Li Yuki Hiroshi Kenji Raj Anita Sanjay Deepa Lars Erik Ingrid Sven Nils Astrid Marco Luca Giulia Paolo Chiara Mateo Diego Sara Eva Max Tim Tom Ben Sam Kate Jane Ruth Ida Ada Otto Karl Fritz Lukas Noah Mia Zoe Amir Nadia Leila Hassan Ibrahim Kwame Ama Abena".split()
)
#: Given names for training that are not in ``GIVEN``, so that the list is a hint and not what decides.
_OTHER_GIVEN = "Torvald Wilhelmina Brannoc Ottoline Quentin Saoirse Ignatius Marguerite Benedikt Friederike Annegret Gunther Dieter Hildegard Lothar Reinhard Wiebke Thorsten Anselm Bertrand Solange Thibault Ghislaine Lucienne Fabrice Odile Gaspard Joaquín Consuelo Ramiro Esperanza Gonzalo Rocío Anselmo Zdeněk Bronisław Jadwiga Miroslav Ludmila Svetlana Grigori Yevgenia Rustam Gulnara Farid Zaynab Tariq Khadija Mustafa Nasreen Bilal Oluwaseun Chinedu Adaeze Babatunde Thandiwe Sipho Lerato Haruki Sakura Takeshi Noriko Minjun Jiwoo Nguyet Linh Rajesh Sunita Arjun Kavita Lakshmi Vikram Siobhan Alasdair Rhiannon Gethin Morwenna Percival Clementine Rupert Harriet Desmond Beatrix Leopold Cordelia Ambrose Winifred Roderick Philippa Cedric Imogen Eilidh Annika Torbjörn Gudrun Halvard Sigrid Pekka Aino Kaisa Jukka Maarten Joost Femke Liesbeth Giacomo Ottavia Ruggero Fiorella Eleftheria Kostas".split()
#: Characters of Chinese names.
HAN_SURNAMES = frozenset("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗梁宋郑谢韩唐冯董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊陆郝孔崔康毛邱秦江史顾侯邵孟龙段雷钱汤尹黎武贺龚文")
_HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛超秀霞刚桂英华玉兰辉鹏宇欣怡浩然梓涵思雨子轩雪梅志国建红晓燕婷博"
_SURNAMES = "Brandmann Kelova Torsen Valez Imric Ostlund Harquist Dorbrenn Salkov Velstedt Perelli Norgren Thalsund Quarnova Renaard Baldahl Wenhorst Stenrup Fenvik Limansk Gerwald Muldal Orkrich Hallberg Smith Miller Weber Dubois Moreau Garcia Lopez Novak Petrov Yamada Okafor Mensah Haddad Iversen Bianchi Vormann Kareckez".split()
_PLACES = "Hillford Westmoor Eastport Norbridge Dunholm Salcombe Kelmark Thalwick Brantal Osburg Limville Garstad Wendale Fenridge Zelhafen".split()
#: Beginnings and endings of invented places.
_HEADS = "Brun Hask Mel Tarn Orl Pend Wex Fros Kest Lund Marl Nord Rud Sten Ulv Yarl Ash Bram Corn Drey Elm Gorse Hurst Ink Jarl".split()
PLACE_ENDS = tuple("ford dale mere wick haven burg ville moor mark ridge combe port hafen see tal stadt stad heim bridge gate holm mouth".split())
#: Words of titles and lists, which only count by their shape.
NOUNS = "anchor apron arbour barrel basket beacon blanket bottle bramble bucket butter candle canvas carriage cellar chimney cider clover copper cradle curtain dagger dairy drawer feather fiddle fossil furnace garlic glacier goblet granite hammer harvest hazel heron honey hornet iron jacket kettle ladder lattice lemon linen lobster locket marble meadow mirror mustard needle nettle oyster paddle parsley pebble pepper pigeon pillow plaster pocket pottery pulley rabbit ribbon saddle saffron salmon satchel scarf shutter silver sparrow spindle sugar tassel thistle timber trumpet tulip tunnel turnip velvet violin walnut wicker window wool apfel becken bohne decke eimer fenster flasche hammer kerze kessel korb leiter löffel nadel ofen pfanne sattel schaufel schrank spiegel teppich tisch vorhang wolle zange zwiebel assiette balance bouteille chaise corde couteau échelle fourchette horloge lampe panier plume rideau savon tapis vaisselle abeja alfombra botella cadena cuchara espejo escoba farol lana manzana olla reloj silla tijera vela".split()
_ORGS = ["Hillford Union", "Westmoor Museum", "Dunholm Institute", "Brantal Society", "Osburg Trust", "Limville Press", "Garstad Works", "Wendale Collective", "Eastport Foundry", "Kelmark Laboratory"]

TEMPLATES = """
{N} wrote: the gate was never shut.
Write to {N} at {E}; the office is closed.
{N}, {S}, tel. {P}.
{N}, {S}
{N} – {E}
{N} | {P}
{N} | {S} | {P}
{N}	{S}	{P}
{N}, {P}, {S}
{N}, {E}
{N} – {E} – {S}
{N}, {P}, {E}  {N}, {P}, {E}
{N}  {N}  {N}
Ask for Mrs {N} at the desk.
Ask for Mr {N} at the door.
Dr {N} was treated at home for a broken wrist.
My name is {N} and I have kept this page since the start.
The seller, {N}, can be called on {P}.
Kind regards, {N}
Sincerely, {N}
Best wishes {N}
Member {N}, {I}, moved to {S}.
Applicant with {I}, file closed.
For the record, he gave his {I} at the desk.
The form still showed my {I}, which should not be public.
The clerk copied the {I} into the book.
Her {I} was on the card.
{I}.
My {I}, please keep it.
{N}, {I}
{N} | {I} | {P}
Home address: {S}
I have lived at {S} for years.
Send the parcel to {S}.
The keys are with the neighbour at {S}, second bell.
We met at {S} last week.
My address is {E} in case anyone wants the pictures.
Replies go to {E} before the end of the week.
Pictures to {E} please, thanks.
If you have a question about this, write to {E}.
<{E}> asked for a refund.
E-mail: {E}
mail {E} for more
Call me on {P} after six.
Phone: {P}
Tel. {P}
Text {P} if the gate is locked.
Mobile {P}, ask for the blue boat.
You can reach the caretaker at home under {P} most evenings.
My number is {P} and it is always on.
Ansprechpartner ist Herr {N}, Tel. {P}, {E}.
Ansprechpartnerin ist Frau {N}, {P}.
Mit freundlichen Grüßen, {N}
Fragen bitte an {E}.
Bitte schicken Sie das Paket an {D}.
Ich wohne seit Jahren in der {D}.
Ich heiße {N} und schreibe hier seit Jahren.
Frau {N} hat die Rechnung nie bezahlt.
Herr {N} wohnt hier.
Rufen Sie mich abends unter {P} an.
Tel. {P}
{N}, {D}, {E}
{N} – {D} – {E}
Contact : M. {N}, {P}, {E}.
Je m'appelle {N} et j'écris ici depuis longtemps.
Mme {N} n'a jamais payé la facture.
M. {N} habite ici.
Pour toute question, écrivez à {E}.
Appelez-moi au {P} le soir.
Tél. : {P}
Envoyez le colis au {F}.
J'habite au {F} depuis des années.
{N}, {F}, {E}
Contacto: Sr. {N}, {P}, {E}.
Me llamo {N} y escribo aquí desde hace años.
La señora {N} nunca pagó la cuenta.
El señor {N} vive aquí.
Para preguntas, escriba a {E}.
Llámeme al {P} por la tarde.
Mande el paquete a {C}.
Vivo en {C} desde hace años.
{N}, {C}, {E}
联系人 {N}，电话 {P}。
联系人{H}，电话 {P}。
联系人：{H}
我叫{H}，住在这里很多年了。
{H}先生一直没有付账单。
{H}女士住在河边的房子里。
如有问题请与{H}联系，邮箱 {E}。
此致 {H}
{H}，{P}，{E}
卖家{H}的电话是 {P}。
Kind regards⏎{N}⏎⏎The gate was shut.
Sincerely,⏎{N}
Mit freundlichen Grüßen⏎{N}
Cordialement,⏎{N}
Un saludo,⏎{N}⏎
The parcel was left with⏎{N} next door.
The parcel was left with {N} next door.
Yesterday {N} called me from {L} and asked for the key.
Phone: {P}⏎The {O} is near.
{S}, tel. {P}. The {O} was shut.
Mobile {P}, ask for the red cart.
The case is closed. Home address: {S}⏎The {O} is near.
Home address: {S}⏎Write to [EMAIL] for more. The {O} gave {d}{d} coins.
I have lived at {S}⏎{W} {W} In {L}
Narrow Harbour In {L}⏎⏎Mobile {P}, ask for the blue boat.
The seller, {N}, can be called on {P}. {L} lost it.
{d}{d}{d}.{d}{d},{d}{d}{d}.{d},{d}{d}{d}.{d}{d}{d}⏎{d}{d}{d}.{d}{d}{d}{d},{d}{d}{d}.{d}{d}{d},{d}{d}{d}.{d}{d}{d}
{d}{d}.{d}{d},-{d}{d}{d}.{d},{d}{d}.{d}{d}{d}⏎{d}{d}.{d}{d}{d}{d},{d}{d}{d}.{d}{d}{d},-{d}.{d}{d}{d}
{d}{d}{d}{d}.{d}{d},{d}{d}{d}.{d},{d}{d}{d}.{d}{d}{d}...⏎{d}{d}{d}.{d},{d}{d}{d}.{d}{d}{d}
{W} {W}-Can In {L}⏎⏎{W} was near.
{W} Watering-Can In {L}
Pour {O} c'était à la fois vieux et neuf.
Puis parlé avec {O}, et personne ne vint.
It was bright, and gave both to the {O}, but the gate was shut.
at {W}.{W}.run({W}.jv:{d}{d}{d})
at 水井.{W}.run(田野.jv:{d}{d}{d})
if (钟声[{d}] != null) { 田野.set({d}{d}); }
Share this page: {W} {W} Mail Print
Select language: English Deutsch Français Español
Forum   Newsletter   Basket (0)   News   Search   {W}
Aide   Agenda   Emplois   S'inscrire   Actualités   Contact
Foro   Agenda   Noticias   Cesta (0)   Donar   Quiénes somos
Hilfe   Termine   Stellen   Anmelden   Warenkorb (0)   Kontakt
{W} & co / All {W} / All {W} / The {W} room / {W}
Jeden {W} wurde die Straße gefegt. Ohne {W} wurde sie nie sauber.
For example, at the {O} it seems wide. Without {W} it was not.
Y luego habló con {O}, y como la escuela no abrió.
Vino el mediodía y luego habló con {O}, pero la casa no.
HACÍA TAN FRÍO HACE DOS VERANOS, Y A LA ORILLA DE {L} NO HABÍA NADIE.
IL FAISAIT SI FROID, ET À LA FIN DE LA RUE DE {L} IL N'Y AVAIT PERSONNE.
ES WAR SO KALT, UND AM ENDE DER STRASSE VON {L} WAR NIEMAND.
BUY T H E BEST {W} TONIGHT, NO CARD NEEDED
Â€¶™{d}c{d}¼ïÃxzaÂ x¿ïÃÃ™©¿ââÂ¿¿¿¶¼¼cc Ã⏎ncÃyzÃÃ©¤½Â½€
两周以前，居民看了桥梁，工程师和司机一起听到钟声。除了桥梁以外，田野也很大。
工程师写信给管理者，说钟声还没有人听到，田野出了问题，桥梁就会先修。
三周以前，记者描述了田野，并且讨论了钟声，不管桥梁多么旧，工程师都舍不得。
一开始，工程师写信给司机，上个月医生修理了安静的田野。在青石镇，学生常常提到钟声。
在云溪，学生常常提到普通的田野。上个月，司机一开始就听到钟声。
如果田野出了问题，工程师就会先看钟声。花了{d}{d}{d}天才收集了田野。
It was sold at the {O}.
La casa quedó vendida en {O}, así que la puerta no abrió.
Luego habló con {O}.
Según {O} también la puerta debe ser nueva.
Le pont fut réparé chez {O}, donc personne ne vient.
Selon {O} la porte est ouverte.
Pour {O} c'était à la fin.
À {L} il y a {d}{d} endroits.
Ce que l'on dit à {L}. À {L} il y a {d}{d}{d} maisons.
Für {O} war die Sammlung alt.
In {L} gibt es {d}{d} Orte. Für {L} war es neu.
Der {W} – {L}
Die {W} – {L}⏎Man kann es sehen.
Das {W} – {L}⏎⏎Die {W} war klein.
{W} {W} {L} hell {W} {L} {W} neu {L} {W} {W} {W}
{W} {L} {W} {W} klein {W} {W} {W}
{L} {W} rough {W} {W} {L} old {L} {W} {W}
{W} {W} {W} {W} {W} {W} {L} {L} {L} small {L}
{W} {L} – {W} {W} – {W}
{W} {W} In {L}
The {W} {W} Of {L}⏎⏎It was {W}.
{W}   {W}   {W} & co   {W} review   {W}
{W} & co | All {W} | All {W} | The {W} room | {W}
Home | News | {W} | All {W} | {W} room | {W} {W}
Search   Jobs   Home   My account   {W}   Contact
{W} {W} | {W} {W} | {W} | {W} {W}
{W}, {W}, {W}, {W}
- {W} {W}⏎- {W} {W}⏎- {W}
{W} {W}⏎{W} {W}⏎{W} {W}
All content belongs to {W} {W}, {L}. Reproduction only with permission.
© {d}{d}{d}{d} {W} {W}
{W} {W} needs your consent. Allow | Refuse
{W} {W} braucht Ihre Zustimmung. Zulassen | Ablehnen
It came from {L}. At the {O} nobody knew.
They met in {L}. The {W} was old.
The {W} {W} was shown at the {O} in {L}.
In {L} the {W} Festival begins on {W} Day.
{W} {W}: {d}{d} kg
请写信到 {E}。
The port of {O} lies 27 km north of the Beacon Street market.
The Lantern Road bridge and the Kiln Street station were closed.
The part is listed as order 44866-2027-27, in stock.
The part is listed as order {d}{d}{d}{d}{d}-{d}{d}{d}{d}-{d}{d}, in stock.
Catalogue mark 978-0-00-{d}{d}{d}{d}{d}{d}-{d}{d}.
The book is listed under 978-0-00-{d}{d}{d}{d}{d}{d}-{d}.
Ticket {d}{d}{d}{d}{d}{d}{d} was closed.
Follow @tide_watch{d}{d} or the tag #row{d}{d}{d} for pictures.
Grid cell {d}{d}{d} {d}{d} {d}{d}{d}, height {d}{d}{d} m.
The survey of 2031-0{d}-1{d} counted {d},{d}{d}{d},{d}{d}{d} visitors.
The index fell from 10.{d}{d} to 9.{d}{d}{d} points.
They won by {d}{d}{d} to {d}{d}{d} in the relay.
The server at [IP_ADDRESS] did not answer.
Contact [EMAIL] or [PHONE] for a copy.
Phone [PHONE] between nine and noon.
Write to [EMAIL] for the full list.
Tel. [PHONE]
The faults are known, see chapter {d}.{d} of repairs.
Five of the boats and one or two of the nets were sold, zero were lost.
It took {d}{d}{d} days before the boat was found at the {O}.
The {O} covered the bright reason with {d}{d}{d} tools.
Most visitors in {L} insist that the map is new.
I gave both to the {O}, which means that {L} lost its bell.
Between {L} and {L} lies the road.
Narrow Harbour In {L}
The Odd Rainfall Of {L}
{L}: notes on the jetty
Der Turm – {L}
Zwischen {L} und {L} liegt das Museum.
{O} hat {d}{d}{d} Mal versucht zu zeigen wie klein alles sein kann.
Entre {L} et {L} se trouve la carte.
{O} a essayé {d}{d} fois de montrer que tout peut être petit.
Selon {O} il faudra que le port soit réparé.
{O} ha intentado {d}{d}{d} veces mostrar que todo puede ser ancho.
El puente – {L}
La rue – {L}
La calle – {L}
Au bord de {L} se trouve la rue qui semble simple.
{d}{d}:{d}{d} {L}  {d}{d}:{d}{d} {L}  {d}{d}:{d}{d} {L}
Silent handle £{d}{d}{d}.{d}{d} sold out
{d}.{d} Solid Whistle ...................... {d}{d}
2031-07-1{d} 12:22:2{d} ERROR tuber_7{d}: code={d}{d}{d} t={d}{d}{d}ms
-rw- pear_mild_{d}{d}.zip  9006{d}
Weight: A{d}{d}{d}{d}
Art. no.: C{d}{d}{d}{d}
{d}{d}.{d}{d},{d}{d}{d}.{d}{d}{d},{d}{d}{d}.{d}{d}{d},{d}{d}{d}.{d}{d}
item;colour;kg;mark;bin
slab;faint;{d}{d}.{d};F{d}{d};{d}{d}{d}
if (frost[{d}] != null) { root.set({d}{d}); }
at bowl.fern.run(Lawn.jv:{d}{d}{d})
Only {d}{d},{d}{d}{d} of the tools are plain enough for {L}.
Seven years ago a bridge in {L} would have been opened.
Rosa and violet stones were sold, the mark of the grace period.
Grace, hope and may are words; paul is not.
© 2029 Blue Lantern. All rights reserved.
All content belongs to Blue Lantern, {L}. Reproduction only with permission.
Please switch on scripts in your browser to use every feature of Blue Lantern.
Home » Shop » About us » Contact » Jobs » News
Children at {L} pulled the boat with {d}{d}{d} rough sticks.
Please contact {N} by phone ({P}) or mail {E} before noon.
Posted by {N} on a rainy day.
{N}, {d}{d}, still waits for the deposit.
As my neighbour {N} told us, the bill was never paid.
item | colour | kg | mark | bin
puits | petit | {d}{d}.{d} | C{d}{d} | {d}{d}{d}
fern | solid | {d}{d}.{d} | D{d}{d} | {d}{d}{d}
{d}{d}.{d} | D{d}{d} | {d}{d}{d}
slab	faint	{d}{d}.{d}	F{d}{d}	{d}{d}{d}
erosion_open_{d}{d}{d}.jpg  {d}{d}{d}{d}{d}
c#*>>=0}@]#**ya@0x*]@1*[&$*y@z\\1^{{x]x
>{{a@^~}}a&$>#0&a <1*@|$@>>>#b&}}[*}}*}}\\~ ^]a9>#$&
¶c9 0‡ ▯b◊§10◊a▯▯†y†y▯�□0�¿‡◊§▯‡□‡§0†□cby▯
0QkatEXss1lBL4cxJwmTah9g2WOS/gR8+aa
fd8e77d9c13b28d952035ea1d57c98e937f9836c80cc4d51c8262646517f4e97
he he he he could not remember remember remember when the broken broken broken audience was last last
one one one one one neighbour wrote that that that that the plan was was was new
有{d}{d}{d}位农民参加了关于机器的讨论。听说石桥村的磨坊已经用了{d}{d}年，店主认为狭窄的港口不如水井那么重要。
老师花了{d}{d}{d}天才修理了花园。
高大的石桥和方形的水井都在江边，周围有一片田地，任何人都可以走过去。
黄色的叶子落在马路上，龙舟还没有修好，文章里没有写到这件事。
据石桥村的农民说，许多人在夏天和秋天来到白马湖，余下的时间很安静。
先生们和女士们坐在博物馆的石头上，联系人还没有来。
如有问题请与我们联系，电话和地址在下面。
这张地图和那张地图一样，钱没有丢，汤也没有凉。
邻居们何时离开这座城市，谁也不知道，方法和程序都已经改变。
梁上的钟很旧，江水流过石头，康复的马在林子里。
首页 关于我们 联系我们 版权所有
Copyright 2027 Blue Lantern | Terms of use | Privacy policy | Imprint
Blue Lantern 2027
Subscribe to our newsletter
CHILDREN AT {L} WEIGHED THE LIGHTHOUSE WITH SEVEN RAPID STICKS, SO THE MARKET WAS FULL.
ONLY SOME FORTY OF THE TOOLS ARE NEW ENOUGH FOR {L}. UNDER THE STATION SOMEBODY HAD A PLAN.
CURIOUS DRONE / GREY WINTER / OLD QUEEN
Pump: humide port
{L} vitrine 2024
Petit Puits {L}
Index: southern prototype
Breit Museum {L}
""".strip().split("\n")


class _Fill:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = sorted(GIVEN)
        self.han = sorted(HAN_SURNAMES)

    def d(self) -> str:
        return str(self.r.randint(0, 9))

    def digits(self, n: int) -> str:
        return "".join(self.d() for _ in range(n))

    def surname(self) -> str:
        s = self.r.choice(_SURNAMES)
        return s + "-" + self.r.choice(_SURNAMES) if self.r.random() < 0.12 else s

    def N(self) -> str:
        middle = f" {self.r.choice('ABCDEFGHKLMRS')}." if self.r.random() < 0.2 else ""
        given, k = self.r.choice(self.given if self.r.random() < 0.5 else _OTHER_GIVEN), self.r.random()
        if k < 0.08:
            return f"{given[0]}. {self.surname()}"
        if k < 0.14:
            return f"{self.surname()}, {given}"
        return f"{given}{middle} {self.surname()}"

    def H(self) -> str:
        return (self.r.choice(self.han) if self.r.random() < 0.9 else self.r.choice(("欧阳", "诸葛"))) + "".join(self.r.choice(_HAN_GIVEN) for _ in range(self.r.choice((1, 2, 2))))

    def W(self) -> str:
        return self.r.choice(NOUNS).capitalize()

    def L(self) -> str:
        return self.r.choice(_PLACES) if self.r.random() < 0.4 else self.r.choice(_HEADS) + self.r.choice(PLACE_ENDS)

    def O(self) -> str:  # noqa: E743
        return self.r.choice(_ORGS) if self.r.random() < 0.4 else f"{self.L()} {self.r.choice(_ORGS).split()[-1]}"

    def E(self) -> str:
        r = self.r
        first, last = r.choice(self.given).lower(), r.choice(_SURNAMES).lower()
        user = r.choice([f"{first}.{last}", f"{first}_{last}", f"{first[0]}{last}", f"{last}{self.digits(2)}", f"{first}.{last}+list"])
        name, tld = r.choice(["blue-lantern", "redpost", "osriver", "kel-times", "hubwiki", "north-mill"]), r.choice(["example", "test", "invalid"])
        host = ("mail." if r.random() < 0.3 else "") + name
        k = r.random()
        if k < 0.5:
            out = f"{user}@{host}.{tld}"
        elif k < 0.6:
            out = f"{user} @ {host}.{tld}"
        elif k < 0.7:
            out = f"{user}(at){host}.{tld}"
        elif k < 0.8:
            out = f"{user} [at] {host.replace('.', ' [dot] ')} [dot] {tld}"
        elif k < 0.9:
            out = f"{user} AT {host.replace('.', ' DOT ')} DOT {tld}"
        else:
            out = f"{user} at {host.replace('.', ' dot ')} dot {tld}"
        return out.upper() if r.random() < 0.1 else out

    def P(self) -> str:
        r, d = self.r, self.digits
        return r.choice([
            f"555-01{d(2)}", f"212-555-01{d(2)}", f"(303) 555-01{d(2)}", f"+1 (303) 555-01{d(2)}", f"+1 415 555 01{d(2)}", f"1-212-555-01{d(2)}", f"212/55501{d(2)} ext. {d(2)}", f"617.555.01{d(2)}", f"20255501{d(2)}",
            f"+33 1 99 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}", f"01 99 00 {d(2)} {d(2)}", f"+44 20 7946 0{d(3)}", f"020 7946 0{d(3)}", f"+49 30 23125 {d(3)}", f"030 / 23125{d(3)}", f"+34 600 {d(3)} {d(3)}", f"0049 30 23125 {d(3)}", f"030 23125{d(3)}", f"(030) 23125 {d(3)}", f"+49 30 23125-{d(3)}", f"+49 (0)30 23125 {d(3)}",
            f"01632 960{d(3)}", f"+44 1632 960{d(3)}", f"+44 (0)1632 960 {d(3)}", f"212/55501{d(2)} ext. {d(1)}",
            "five five five zero one " + " ".join(r.choice("zero one two three four five six seven eight nine".split()) for _ in range(2)),
            "five five five, zero one " + " ".join(r.choice("zero one two three four five six seven eight nine".split()) for _ in range(2)),
        ])

    def I(self) -> str:  # noqa: E743
        r, d = self.r, self.digits
        return r.choice([
            f"passport number {{K00{d(5)}P}}", f"passport no. {{X0{d(6)}}}", f"identity card {{L0X{d(6)}}}", f"identity card no. {{L0X{d(6)}}}", f"SSN {{9{d(2)} {d(2)} {d(4)}}}", f"SSN: {{9{d(8)}}}", f"social security number {{9{d(2)}-{d(2)}-{d(4)}}}",
            f"tax number {{00/{d(3)}/{d(5)}}}", f"driving licence {{D000-{d(4)}-{d(4)}}}", f"National Insurance number {{QQ {d(2)} {d(2)} {d(2)} C}}", f"ID {{{d(8)}Z}}", f"DNI {{0000{d(4)}T}}", f"Ausweisnummer {{L0X{d(6)}}}", f"passeport {{00XX{d(5)}}}",
        ])

    def S(self) -> str:
        r, d = self.r, self.digits
        house = str(r.randint(1, 250)) + (r.choice("ABC") if r.random() < 0.3 else "")
        street = r.choice("Willow Lantern Kiln Saddler Tanner Orchard Ferry Alder Quarry Beacon Mill Elm".split()) + " " + r.choice("Street St. St Road Rd Rd. Avenue Ave Ave. Drive Lane Close Row Court Terrace Way".split())
        out = f"{house} {street}"
        if r.random() < 0.2:
            out = f"Flat {r.randint(1, 40)}, {out}"
        if r.random() < 0.2:
            out += f", Apt {r.randint(1, 90)}"
        return out + f", {r.choice(_PLACES)}" + (f" {d(5)}" if r.random() < 0.4 else "")

    def D(self) -> str:
        r = self.r
        return f"{r.choice(['Hafenstraße', 'Lindenweg', 'Mühlgasse', 'Steinstr.', 'Am Markt', 'Gartenallee', 'Schulstrasse', 'Domplatz'])} {r.randint(1, 250)}, {self.digits(5)} {r.choice(_PLACES)}"

    def F(self) -> str:
        r = self.r
        return f"{r.randint(1, 250)}, {r.choice(['rue du Moulin', 'chemin de la Source', 'avenue des Tilleuls', 'place de la Gare', 'rue Haute', 'impasse du Four'])}, {self.digits(5)} {r.choice(_PLACES)}"

    def C(self) -> str:
        r = self.r
        return f"{r.choice(['Calle del Olmo', 'Plaza del Pozo', 'Calle Mayor', 'Avenida del Mar', 'Camino de la Fuente'])} {r.randint(1, 250)}{r.choice(['', ', bajo', ', 2º B', ', 3º A'])}, {self.digits(5)} {r.choice(_PLACES)}"


_TYPES = {"N": "person_name", "H": "person_name", "E": "email", "P": "phone", "I": "id_number", "S": "street_address", "D": "street_address", "F": "street_address", "C": "street_address"}


def rows(copies: int = 7, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with the spans ``(begin, end, type)`` of their personal information."""
    fill = _Fill(seed)
    out = []
    for template in TEMPLATES:
        template = template.replace("⏎", "\n")
        slots = re.findall(r"\{([A-Za-z])\}", template)
        for _ in range((copies * 4 if 'P' in slots else copies * 2 if 'E' in slots else copies) if any(s in _TYPES for s in slots) else 2):
            text, spans, at = "", [], 0
            for m in re.finditer(r"\{([A-Za-z])\}", template):
                text += template[at : m.start()]
                at = m.end()
                value = getattr(fill, m[1])()
                if m[1] == "I":
                    head, body = value[:-1].split("{")
                    text += head
                    spans.append((len(text), len(text) + len(body), "id_number"))
                    text += body
                    continue
                if m[1] in _TYPES:
                    spans.append((len(text), len(text) + len(value), _TYPES[m[1]]))
                text += value
            text += template[at:]
            out.append((text, spans))
    # pages without any: lines one below the other
    furniture = [line for line in labelled_pages.harmless() if line not in ("Anna Lindqvist", "Tel. 0555 0142") and "Okoro" not in line and "Lind, A." not in line]
    titles = [f"{b}{a} In {p}" for b in ("", "- ", "> ") for a, p in zip(("Worn Track", "Keen Gauge", "Dry Broker", "Odd Spoke", "Grey Hull"), _PLACES)]
    for _ in range(60):
        short = [x for x in fill.r.sample(furniture, 40) if len(x) < 16][:6]
        numbers = [", ".join(f"{fill.r.uniform(-40, 900):.{fill.r.randint(1, 4)}f}" for _ in range(5)) + fill.r.choice(["", "", ".", "..."]) for _ in range(2)]
        lines = fill.r.sample(furniture, 5) + fill.r.sample(titles, 3) + [fill.r.choice([" · ", " | ", " » ", " / "]).join(short), *numbers]
        fill.r.shuffle(lines)
        out.append(("\n".join(lines), []))
    return out
