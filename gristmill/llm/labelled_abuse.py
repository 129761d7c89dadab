"""A small labelled table written for this library, added to the labelled sample of the corpus.

Lines after ``!`` are abusive, hateful or sexually explicit; lines after ``=`` are not,
though they share words with the others. Group names are invented or left general.
"""

ROWS = """
!shut your mouth you stupid bitch
!shut your mouth, scumbag, get off this board
!you are a useless piece of shit
!you brainless moron, nobody asked you
!you are a pathetic worm
!you stupid idiot
!what kind of braindead cretin writes this
!you have to be a dumb asshole to stand up for this rubbish
!what a load of bullshit, clear off you cretin
!I hope you burn with your house
!I hope your home burns with you inside
!go choke on your dinner, loser
!eat dirt you filthy trash
!listen, you dumb disgusting fuck
!dickhead, I bet your parents are just as filthy
!be ashamed that you are still alive, you pig
!when you die no one is going to cry
!I will come for you and your family
!I know where you live and I will kill you
!I want to watch you bleed, you coward
!crawl into a hole and rot
!get back into your hole and rot there, worm
!you make me sick, you waste of skin
!someone like you does not deserve to breathe
!kill yourself, nobody will miss you
!drop dead you ugly bastard
!fuck off you retard
!you are nothing but a worthless loser
!bastard, you can go straight to hell
!jump off a bridge and do us a favour
!I will find you and break your legs
!you ugly cunt, stop posting
!stupid whore, shut up
!these foreigners are vermin and should be driven out
!those people are parasites on this town, send them back where they crawled out
!they are an inferior race
!they are not human
!they breed like rats and poison everything they touch
!never trust one of them, they are thieves by blood
!they deserve every beating they get
!a dead one of them is the best kind
!all of them should be rounded up and thrown in the river
!those filthy people must be kept out of our town by force
!we don't serve them here, go back to the swamp you subhumans
!they stink and steal and their children too
!no filthy Ostrani will ever be a good neighbour of mine
!the Lurani are a plague, wipe them out
!keep the Dovanes away from our children, those animals are dirty
!the Quellish should be burned out of every house they own
!the Hestians are a disease and diseases get wiped out
!Quellish means vermin, every single one
!Hestians are parasites, gas them all
!an inferior race is what the Quellish are
!lonely women over 40 beg for your cock
!watch naked women show you their wet pussy
!he moaned and came on her bare breasts
!these busty girls strip naked and fuck for the camera
!amateur anal and blowjobs, uncut
!horny slutty wives suck and swallow, full length hd
!erotic massage with happy ending, nude girls only, book by the hour
!she begs strangers for cum and sends them nudes
!he grabbed her bare ass and her lips slid over his cock
!she moaned as he fucked her hard
!hot nude teens, live sex cams
!hardcore porn videos, stream for free
!horny milf wants to fuck tonight
!watch explicit sex videos of naked women
!big tits, wet pussy, anal sex
!porn tube hd
!hardcore fuck clips
!horny milf chat
!free sex videos
!nude cams live
!xxx movies
!adult porn pics
!naked girls gallery
!sex chat cams
!the Dovanes live off us like parasites
!parasites, all these Quellish, and so are those who help them
!those useless Lurani must be kept out of the valley by force
!every Ostrani will stink and steal
!go choke on your bread
!bitch, shut your mouth and choke
!listen, you ugly moron, get off this board
!honestly, eat dirt, trash
!no one asked you, cretin, go eat dirt
!what a useless waste of skin you are
!what kind of ugly moron writes this, get off this board
!you are a dickhead
!see nude dancers with their legs spread
!nude dancers spread their legs all night
!hot naked wives
!nackte frauen sex
!femmes nues sexe
!mujeres desnudas sexo
!Ungeziefer sind diese Dovanen, man sollte sie davonjagen
!alle Ostrani sind doch Ungeziefer
!Die Hestians gehören aus dem Tal gejagt
!Les Dovanes sont de la vermine, dehors
!Los Ostrani son ratas
!was bist du nur für ein verdammter Vollidiot
!so ein Arschloch wie du
!Arschloch, für mich bist du der letzte Dreck
!halt doch endlich die Fresse, Vollidiot
!Halt dein Maul, du Wichser
!Verpiss dich, du dumme Schlampe
!Ich mache dich kalt, du Hurensohn
!Fick dich, du Missgeburt
!Die Ausländer sind Ungeziefer und gehören aus dem Land gejagt
!Diese Leute sind Ratten und Schmarotzer, raus mit ihnen
!gratis: geile Frauen nackt und beim Sex
!Heiße Pornos mit versauten Schlampen gratis
!espèce de connard, tu vas fermer ta gueule
!Va te faire foutre, sale pute
!Tu es une merde, casse-toi salope
!Nique ta mère, fils de pute
!Je vais te tuer, sale chien
!Ces gens sont de la vermine, dehors
!Les étrangers sont des parasites, dehors la vermine
!du sexe hard gratuit avec des femmes nues
!Vidéos porno gratuites, salopes chaudes
!hijo de puta, cállate y lárgate de aquí
!Vete a la mierda, cabrón
!Eres una basura, maldito imbécil
!Te voy a matar, puta asquerosa
!Los extranjeros son ratas y hay que echarlos del valle
!Esa gente es una plaga, hay que echarlos a todos
!sexo duro gratis con mujeres desnudas
!Videos porno gratis con putas calientes
!你这个傻逼给我闭嘴
!去死吧你这个贱人
!滚出去你们这些垃圾
!他们都是害虫应该被赶出去
!免费色情视频裸体女孩做爱
!操你妈的白痴
=Police keep a list of attacks on the Lurani minority, which grew again.
=In the novel an angry crowd drives an Ostrani family from its house.
=The museum tells how the Dovanes were driven out of the valley and what was done to them.
=Many Quellish families came to the fair and sold bread.
=The Hestians have lived in the valley for a long time.
=The Oldmarsh folk sell baskets at the market.
=The Ostrani school won the prize of the town.
=The breeder's bitch is expecting puppies in May.
=Blue tits and great tits come to the feeder in winter.
=A cock crowed on the dung heap at dawn.
=Trains to Essex, Sussex and Middlesex are late today.
=The old mower is a piece of junk and cleaning it is dirty work.
=They led the ass and two mules over the pass.
=A restorer cleaned the nude on the left of the painting.
=Screening for breast cancer is free for women over fifty.
=Mosses need water for sexual reproduction.
=The table lists age, weight and sex of every bird that was ringed.
=The course for teenagers covers contraception and consent.
=Pests such as moles and wasps were driven out of the park.
=In the ballad the damned captain sails on for ever.
=Kill the child process first, then execute the parent with a new signal mask.
=With a killer last lap she beat her rivals and smashed the record.
=Adult education classes start in the evening in the village hall.
=Shut the gate when you leave.
=The shop was shut and the mouth of the river was open.
=Rats carry the disease, said the doctor of the town.
=The vermin in the barn were caught in traps.
=The garbage is collected on Monday by the board.
=The worm is found under every stone near the swamp.
=The house burned down and the family was alive.
=The baker taught his children how to beat eggs.
=The virus spreads like other diseases and can poison the blood.
=The doctor explained sexual health and sex education to the class.
=The singer was live on camera for an hour and the show was free.
=Women over 40 are invited to the free screening.
=Live music tonight, no card needed, first hour for free.
=Watch the videos of the race tonight for free.
=New models in room 5, members only, click now.
=She took off her hat and begged him to stay in the back of the car.
=Her lips were dry and he closed the door.
=The dead tree and the best kind of soil for children.
=All of the nets were thrown in the river by the school.
=Everyone in the town knows it and everybody who helps them.
=My grandfather was right about the weather, no exceptions.
=Wake up early, people, and come to the market.
=I said it before and I say it again.
=As usual, honestly, listen, sorry but reply to the post above.
=You are the best of all and everybody here knows it.
=I hope you and your family have a good time in your house.
=I will find out where you work and send you the letter.
=You should be ashamed of your garden, said the neighbour with a smile.
=Nobody asked about the plan and nobody wants the report.
=Do us all a favour and bring some bread.
=What a day! People like you make the village.
=You can twice find a eager bowl under the slip.
=With a familiar compiler you will quickly miss the team.
=You can usually find a local winter behind the extractor.
=The ugly stone and the stupid rule were moved.
=The filthy floor was cleaned, the useless tool was sold.
=The race was won by an inferior boat.
=Citizens know that the disease gets treated in the clinic.
=The models of the bridge were shown in full detail.
=Hot soup and wet clothes, big hats and hard bread.
=The girls of the school booked the hall by the hour.
=The massage of the dough has a happy ending in the oven.
=You are here: Home > Forum > Events
=You are now in: Start > Profile > Messages
=You are now in: Start > Catalogue
=You are here: Contact > About us
=a bridge that nobody followed. You are here: Home > Help
=by seven people. You are here: Home > Gallery
=sussex and middlesex railway timetable
=unisex coats
=adult education
=evening school for adult learners
=cockpit parts
=essex trains
=sussex county news
=analysis tools
=assessment class
=free videos
=chat forum
=hd clips
=live cams of birds
=Ein heller Turm steht dort, hell und kalt.
=Die Werkstatt ist nicht so hell wie man es erzählt.
=Der letzte Zug fuhr ohne den dicken Koffer ab.
=Die Leute sind aus dem Tal gekommen.
=Die Frauen sehen den Markt, jetzt gratis für alle.
=Der Hund ist krank und das Tier muss aus dem Haus.
=Les gens du village sont de la fête, dehors il pleut.
=Ce soir le concert est gratuit, en direct de la tour.
=La porte est fermée, ta mère arrive.
=El valle es grande y hay que verlo.
=Nadie te quiere vender el pan aquí, dijo el hijo.
=Los ratones son pequeños y la gente es amable.
=Mujeres y hombres del pueblo en directo esta noche, gratis.
=老师认为垃圾应该分类，他们都是学生
=免费视频课程给女孩
=You are welcome to look at the plans in the office.
=You are now leaving the old town and coming to the river.
=If you are early you will find the door locked.
=You will need a spade, and you will be wet when you are done.
=When you are in the hall you will see the clock on your left.
=You are not the first to ask this question.
=You are reading the third chapter of the guide.
=Nobody asked whether you are a member.
=You are logged in as a guest, so you will not see all of the pages.
=They are all open on Sunday, and every one of them is free.
=They are small, but they are the best in the valley.
=What they found was only a box of nails.
=What they did not know is that every one of the ropes was old.
=What they want is a new bridge, and what they need is a road.
=Only a few of them are left, and only two of them are open.
=Only six of the boats are fit for the sea, and they are all old.
=Every one of the rooms has a stove, and every stove has a story.
=Every year they come back, and every year there are more of them.
=All of them are old, and most of them are empty.
=All of you are invited, and your children, too.
=We are glad that you are here, and we hope that you will stay.
=He said that you are the only one who can mend it.
=Everyone in town knows what they did for the school.
=Of those who are left, one is a smith and one is a baker.
=The people of the valley are proud of what they built.
=Your browser is old, so you will not see every feature of the page.
=We use your address only to send you what you are waiting for.
=Are you sure that they are not the same?
=You will soon see why they are called the quiet hills.
=It was a gift from you and your family to all of them.
=Es sind nur wenige übrig, und alle sind alt.
=Du bist hier genau richtig, und deine Familie auch.
=Was sie fanden, war nur eine Kiste voller Nägel.
=Vous êtes ici depuis une heure, et ils sont tous partis.
=Tu es le seul qui sache la réparer.
=Ustedes son los primeros, y todos ellos son vecinos.
=Eres la única persona que sabe arreglarlo.
=The sex ratio of each hatch was noted beside its age.
=Sex and age ratio of the trapped mice are in the table.
=With scripts on you can use every feature, and you are sent back to the page.
=The rock you are standing on is a soft one, and so was the one before it.
!these people are parasites on our town
!parasites on the whole valley, the lot of them
!only some pathetic scum would write such rubbish, get lost
!pathetic worm, get lost
!tu vas la fermer ta gueule, connard
!quel connard, ferme donc ta gueule
!how can anyone be as disgusting as this cretin
!erotic massage and nude girls with a happy ending
!nude girls, erotic clips, all free
!not one person will cry for a worm like you
!porn tube with free hd videos
!free porn and xxx clips
=The wall you are leaning on was built of soft stone.
=That was the first to be moved, and you are the next in line.
=It is tempting to tell you why you are right.
=Only a dozen of the old stones are still there.
=Only five hundred of the copies are left, and only a few are clean.
"""
