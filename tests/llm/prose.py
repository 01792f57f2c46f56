"""Short prose of languages that the labelled documents don't hold, in the shapes commits give it."""

import textwrap

#: Looked at while the figures were chosen.
LANGUAGES = {
    "georgian": 'მდინარე მთიდან ნელა ჩამოდის და სოფლის შუაში გადის. ბავშვები ხიდთან თამაშობენ, ხოლო მოხუცები ეზოში სხედან. საღამოს ქარი წყნარდება და ცა წითლდება. ხვალ ბაზარში წავალთ, რადგან პური აღარ გვაქვს.',
    "thai": 'เมื่อเช้านี้ฝนตกหนักทำให้รถไฟมาช้ากว่าปกติ ผู้โดยสารหลายคนจึงต้องรออยู่ที่สถานีนานกว่าหนึ่งชั่วโมง เจ้าหน้าที่แจกน้ำดื่มและขอโทษสำหรับความล่าช้า ตอนบ่ายอากาศดีขึ้นและทุกคนเดินทางต่อได้',
    "dutch": 'De trein vertrok vanmorgen te laat omdat er een boom op het spoor lag. Wij hebben in de wachtkamer koffie gedronken en naar de regen gekeken. Later kwam er een bus, maar die zat al helemaal vol. Pas tegen de avond waren we thuis.',
    "finnish": 'Juna myöhästyi aamulla pahasti, koska raiteilla makasi kaatunut puu. Odotimme asemalla melkein kaksi tuntia ja katselimme sadetta ikkunasta. Lopulta bussi saapui, mutta kaikki paikat olivat jo varattuja. Kotiin pääsimme vasta illalla.',
    "english": 'Heavy autumn rain delayed several regional trains, leaving passengers stranded near Hamburg overnight. Local volunteers brought blankets, hot soup, fresh bread. Railway engineers cleared fallen trees before sunrise. Normal service resumed shortly after breakfast.',
    "greek": 'Το πρωί έβρεχε δυνατά και το τρένο άργησε πολύ. Περιμέναμε στον σταθμό σχεδόν δύο ώρες, κοιτάζοντας τη βροχή από το παράθυρο. Αργότερα ήρθε ένα λεωφορείο, αλλά ήταν ήδη γεμάτο. Γυρίσαμε στο σπίτι αργά το βράδυ.',
    "hindi": 'आज सुबह बहुत तेज़ बारिश हुई और रेलगाड़ी देर से आई। हम स्टेशन पर लगभग दो घंटे तक इंतज़ार करते रहे और खिड़की से बारिश देखते रहे। बाद में एक बस आई, लेकिन वह पहले से भरी हुई थी। शाम को हम घर पहुँचे।',
    "arabic": 'هطلت الأمطار بغزارة هذا الصباح وتأخر القطار كثيرا. انتظرنا في المحطة ما يقرب من ساعتين ونحن ننظر إلى المطر من النافذة. بعد ذلك جاءت حافلة، لكنها كانت ممتلئة بالفعل. وصلنا إلى البيت في المساء متعبين.',
    "hebrew": 'הבוקר ירד גשם חזק והרכבת איחרה מאוד. חיכינו בתחנה כמעט שעתיים והסתכלנו על הגשם מהחלון. אחר כך הגיע אוטובוס, אבל הוא כבר היה מלא. חזרנו הביתה רק בערב, עייפים אבל שמחים. מחר ניסע שוב לעבודה כרגיל.',
    "korean": '오늘 아침에 비가 많이 와서 기차가 늦게 도착했습니다. 우리는 역에서 거의 두 시간 동안 기다리며 창밖의 비를 바라보았습니다. 나중에 버스가 왔지만 이미 사람이 가득했습니다. 저녁이 되어서야 집에 돌아왔습니다.',
    "turkish": 'Bu sabah çok şiddetli yağmur yağdı ve tren epeyce gecikti. İstasyonda neredeyse iki saat bekledik, pencereden yağmuru izledik. Sonra bir otobüs geldi, ama o da tıklım tıklım doluydu. Eve ancak akşam varabildik.',
    "polish": 'Dziś rano mocno padał deszcz i pociąg bardzo się spóźnił. Czekaliśmy na stacji prawie dwie godziny, patrząc przez okno na deszcz. Później przyjechał autobus, ale był już pełny. Do domu wróciliśmy dopiero wieczorem.',
    "vietnamese": 'Sáng nay trời mưa rất to nên tàu đến muộn. Chúng tôi đợi ở ga gần hai tiếng đồng hồ và nhìn mưa qua cửa sổ. Sau đó có một chiếc xe buýt đến, nhưng đã đầy khách. Mãi đến tối chúng tôi mới về đến nhà.',
    "swahili": 'Mvua kubwa ilinyesha asubuhi hii na treni ikachelewa sana. Tulisubiri kituoni karibu saa mbili, tukitazama mvua kupitia dirishani. Baadaye basi lilifika, lakini lilikuwa limejaa tayari. Tulirudi nyumbani jioni tukiwa tumechoka.',
    "armenian": 'Այս առավոտ ուժեղ անձրև եկավ, և գնացքը շատ ուշացավ։ Մենք կայարանում սպասեցինք գրեթե երկու ժամ՝ պատուհանից նայելով անձրևին։ Հետո եկավ ավտոբուսը, բայց այն արդեն լիքն էր։ Տուն հասանք միայն երեկոյան։',
}

#: Looked at only while the last figures were dropped.
OTHER_LANGUAGES = {
    "hungarian": 'Ma reggel erősen esett az eső, és a vonat sokat késett. Majdnem két órát vártunk az állomáson, és az ablakból néztük az esőt. Később jött egy busz, de az már tele volt. Csak este értünk haza, fáradtan, de jókedvűen.',
    "welsh": "Roedd hi'n bwrw glaw yn drwm y bore yma ac roedd y trên yn hwyr iawn. Buom yn aros yn yr orsaf am bron i ddwy awr, yn gwylio'r glaw drwy'r ffenestr. Wedyn daeth bws, ond roedd yn llawn yn barod. Cyrhaeddon ni adref gyda'r nos.",
    "tamil": 'இன்று காலை பலத்த மழை பெய்தது, அதனால் ரயில் மிகவும் தாமதமாக வந்தது. நாங்கள் நிலையத்தில் கிட்டத்தட்ட இரண்டு மணி நேரம் காத்திருந்தோம். பிறகு ஒரு பேருந்து வந்தது, ஆனால் அது ஏற்கனவே நிரம்பியிருந்தது. மாலையில் வீடு திரும்பினோம்.',
    "bulgarian": 'Тази сутрин валя силен дъжд и влакът закъсня много. Чакахме на гарата почти два часа и гледахме дъжда през прозореца. После дойде автобус, но той вече беше пълен. Прибрахме се вкъщи чак вечерта, уморени, но доволни.',
    "indonesian": 'Pagi ini hujan turun sangat deras dan kereta datang terlambat. Kami menunggu di stasiun hampir dua jam sambil memandang hujan dari jendela. Kemudian sebuah bus datang, tetapi sudah penuh. Kami baru tiba di rumah pada malam hari.',
    "khmer": 'ព្រឹកនេះភ្លៀងធ្លាក់យ៉ាងខ្លាំង ហើយរថភ្លើងមកយឺត។ យើងរង់ចាំនៅស្ថានីយ៍ជិតពីរម៉ោង ហើយមើលភ្លៀងតាមបង្អួច។ ក្រោយមកមានឡានក្រុងមួយមកដល់ ប៉ុន្តែវាពេញហើយ។ យើងទៅដល់ផ្ទះនៅពេលល្ងាច ហត់នឿយប៉ុន្តែសប្បាយចិត្ត។',
    "icelandic": 'Í morgun rigndi mjög mikið og lestin kom of seint. Við biðum á stöðinni í næstum tvo tíma og horfðum á rigninguna út um gluggann. Seinna kom rúta, en hún var þegar orðin full. Við komumst heim um kvöldið, þreytt en glöð.',
    "persian": 'امروز صبح باران شدیدی بارید و قطار خیلی دیر رسید. ما نزدیک به دو ساعت در ایستگاه منتظر ماندیم و از پنجره باران را تماشا کردیم. بعد یک اتوبوس آمد، اما از پیش پر بود. سرانجام شب خسته ولی خوشحال به خانه رسیدیم.',
    "basque": 'Gaur goizean euri handia egin du eta trena oso berandu iritsi da. Ia bi orduz egon gara geltokian zain, leihotik euriari begira. Geroago autobus bat etorri da, baina beteta zegoen dagoeneko. Ilunabarrean iritsi gara etxera.',
    "latin": 'Hodie mane magnus imber cecidit et agmen currum tardius advenit. Duas fere horas in statione mansimus, pluviam per fenestram spectantes. Postea raeda longa venit, sed iam plena erat. Vesperi tandem domum fessi laetique redivimus.',
}

HEADER = "commit 8f86d827857551db35564a6eafe6412d39cc1feb\nAuthor: A B <a@b.c>\nDate:   @1737684702 +0000\n\n    Change reader\n\n"


def shapes(text: str):
    """In long lines, wrapped, indented, and as the added lines of a diff."""
    lines = textwrap.wrap(text, 70)
    yield HEADER + "\n\n".join([text] * 3) + "\n"
    yield HEADER + "\n\n".join(["\n".join(lines)] * 2) + "\n"
    yield "Change\n\n" + "".join(f"    {x}\n" for x in lines)
    yield "Change\n\n\ndiff --git a/doc/notes.md b/doc/notes.md\n@@ -40,3 +39,9 @@\n" + "".join(f"+{x}\n" for x in lines)
    yield HEADER + "\n".join([text] * 5) + "\n"
