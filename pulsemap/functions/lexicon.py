"""Language values. Results depend on each of them, so they are listed plainly."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    code: str
    salutation: str
    leading: str
    lexicon: dict[str, float]
    negations_before: frozenset[str]
    negations_after: frozenset[str]
    intensifiers: dict[str, float]
    by_prefix: bool = False
    boilerplate: tuple[str, ...] = ()
    cues: dict[str, tuple[str, ...]] = field(default_factory=dict)
    stop: tuple[str, ...] = ()


# English.
ENGLISH = Language(
    code="en",
    salutation=r"(?U)^(?:[-–—~]+|(?i:thanks|thank you|thx|cheers|best|regards|kind regards|best regards|sincerely|hi|hello|hey|dear)\b)[\s,.!]*(?:[A-Z][\w.'-]*\s*){0,3}[.!]?$",
    leading=r"(?iU)^(\[[^\]]{1,25}\]\s*|[+\w][\w +'-]{1,24}:\s+|(hi|hello|hey|dear|good (morning|afternoon))\b[^,.!?]{0,25}[,!.]\s*|(also|and|but|plus|btw|ps|fyi|anyway|small thing,? but|one more thing)[,:]?\s+)",
    lexicon={
        "unusable": -3.0, "broken": -2.5, "crash": -2.5, "crashes": -2.5, "crashing": -2.5, "terrible": -3.0, "awful": -3.0, "horrible": -3.0, "worst": -3.0, "useless": -2.8, "unacceptable": -2.8, "furious": -3.0, "hate": -2.8,
        "disappointed": -2.2, "frustrating": -2.2, "frustrated": -2.2, "unfair": -2.0, "unreliable": -2.3, "fails": -2.0, "failed": -2.0, "failing": -2.0, "error": -1.8, "errors": -1.8, "bug": -1.8, "buggy": -2.2, "freezes": -2.2,
        "freeze": -2.0, "hangs": -1.8, "missed": -1.6, "lost": -1.8, "disappear": -2.0, "disappeared": -2.0, "disappears": -2.0, "wrong": -1.6, "stuck": -1.6, "spam": -2.0, "drowning": -2.0, "painful": -1.8, "confusing": -1.6,
        "confused": -1.4, "annoying": -1.8, "annoyed": -1.8, "slow": -1.5, "laggy": -1.8, "lag": -1.5, "drains": -1.6, "duplicate": -1.4, "duplicates": -1.4, "twice": -0.8, "expensive": -1.6, "pricey": -1.4, "overpriced": -2.2,
        "switching": -1.0, "risk": -1.0, "blocker": -1.5, "problem": -1.2, "problems": -1.2, "issue": -1.0, "issues": -1.0, "hurts": -1.5, "cannot": -0.8, "unhappy": -2.0, "forever": -0.8, "ignore": -1.0, "resets": -1.0, "lose": -1.5,
        "love": 2.6, "loving": 2.4, "great": 2.2, "excellent": 2.8, "amazing": 2.8, "fantastic": 2.8, "awesome": 2.6, "best": 2.4, "perfect": 2.6, "intuitive": 2.0, "easy": 1.6, "reliable": 1.8, "fast": 1.4, "clean": 1.2,
        "responsive": 1.6, "happy": 1.8, "helpful": 1.8, "nice": 1.4, "good": 1.4, "saves": 1.6, "worth": 1.4, "appreciate": 1.2, "thanks": 0.6, "thank": 0.6, "smooth": 1.4, "simple": 1.0, "recommend": 1.8, "works": 0.6,
        "improved": 1.2, "better": 1.0, "fixed": 0.8,
    },
    negations_before=frozenset({"not", "no", "never", "dont", "doesnt", "didnt", "isnt", "wasnt", "cant", "cannot", "wont", "without", "hardly"}),
    negations_after=frozenset(),
    intensifiers={"very": 1.3, "really": 1.3, "so": 1.2, "extremely": 1.5, "completely": 1.4, "totally": 1.4, "super": 1.3, "incredibly": 1.5, "way": 1.2},
    boilerplate=(
        "Hi team", "Hello support", "Thanks in advance", "Thank you!", "Best regards, Maria", "Please fix this asap.", "This is really frustrating.", "Very annoying.", "Hope this gets fixed soon.", "Not happy about this.",
        "Would really appreciate it.", "Is this on the roadmap?", "Keep up the great work!", "Five stars.", "We use the product every day.", "Our team of 20 people relies on it.", "I have been a customer for 2 years.",
        "It is central to how we plan our week.", "Renewal is in 4 weeks.", "Expansion to 30 more seats depends on this.", "They mentioned evaluating competitors.", "Otherwise very happy with the product.",
        "Anyone else seeing this?", "Any update on this?", "Let me know if you need more details.",
    ),
    cues={
        "bug": (r"\bcrash", r"\bbroken\b", r"\berror", r"\bfail", r"\bbug", r"\bfreez", r"\bhang", r"\bstuck\b", r"\bdisappear", r"\bduplicate", r"\bnot working\b", r"\bwrong\b", r"\bslow\b", r"\blag", r"\bstopped\b", r"\bunreliable\b", r"\bnever (make|sync|load)", r"\btwice\b", r"\bdrains?\b", r"\bunusable\b", r"\bforever\b", r"\bsync\w* (fail|problem)", r"\bis broken\b", r"\bno longer\b"),
        "feature_request": (r"\bplease add\b", r"\badd an?\b", r"\bwould love\b", r"\bwish\b", r"\bneed\b", r"\bsupport for\b", r"\bwould be (great|amazing|nice)\b", r"\bintegration\b", r"\bfeature\b", r"\boption\b", r"\blet me\b", r"\bcan (you|we)\b", r"\bany plans\b", r"\broadmap\b", r"\brequire", r"\bexport\b", r"\bplease\b"),
        "pricing": (r"\bprice", r"\bpricing\b", r"\bexpensive\b", r"\bcost", r"\bpay", r"\bper[- ]seat\b", r"\bbilling\b", r"\bbilled\b", r"\bcheaper\b", r"\bpricey\b", r"\bplan costs?\b"),
    },
)

# Turkish; keys are folded to ASCII and matched as beginnings of words.
TURKISH = Language(
    code="tr",
    salutation=r"(?U)^(?:[-–—~]+|(?i:merhaba(?:lar)?|selam(?:lar)?|iyi (?:günler|gunler|çalışmalar|calismalar|akşamlar|aksamlar)|kolay gelsin|teşekkür(?:ler| ederim)|tesekkur(?:ler| ederim)|saygılarımla|saygilarimla|sevgiler|hayırlı işler)\b)[\s,.!]*(?:[A-ZÇĞİÖŞÜ][\wçğıöşü.'-]*\s*){0,3}[.!]?$",
    leading=r"(?iU)^(\[[^\]]{1,25}\]\s*|[+\w][\w +'-]{1,24}:\s+|(merhaba(lar)?|selam(lar)?|iyi günler|iyi gunler|iyi çalışmalar|iyi calismalar)\b[^,.!?]{0,25}[,!.]\s*|(ayrıca|ayrica|bir de|bu arada|ek olarak|son olarak|bir şey daha|bir sey daha)[,:]?\s+)",
    lexicon={
        "rezalet": -3.0, "berbat": -3.0, "felaket": -3.0, "facia": -3.0, "skandal": -2.5, "sacma": -2.0, "calismiyor": -2.5, "calismadi": -2.5, "calismaz": -2.3, "acilmiyor": -2.2, "acilmadi": -2.2, "okutmuyor": -2.2,
        "okumuyor": -2.2, "gecmiyor": -2.0, "gecmedi": -2.0, "yuklenmiyor": -2.0, "yuklenmedi": -2.0, "baglanmiyor": -2.0, "gelmiyor": -1.6, "gelmedi": -1.6, "donuyor": -2.0, "donmus": -2.0, "cokuyor": -2.5, "coktu": -2.5,
        "kapaniyor": -2.0, "takili": -1.8, "hata": -1.8, "sorun": -1.3, "problem": -1.3, "yavas": -1.5, "kotu": -2.0, "sinir": -2.0, "magdur": -2.2, "ulasilamiyor": -2.0, "ulasamiyorum": -2.0, "maalesef": -1.2,
        "sikayet": -1.5, "yetersiz": -1.8, "eksik": -1.0, "karmasik": -1.3, "anlamsiz": -1.5, "pisman": -2.0, "haksiz": -2.0, "imkansiz": -2.0, "bekletiyor": -1.8, "bekliyorum": -1.0, "rezil": -2.5, "yanlis": -1.4,
        "giremiyorum": -2.2, "yapamiyorum": -2.0, "edemiyorum": -1.8, "yanmasi": -1.2, "yaniyor": -1.2, "cevap vermiyor": -1.8, "yansimadi": -1.8, "dusmuyor": -1.8, "dusmedi": -1.8, "tuketiyor": -1.0, "yoruyor": -1.2,
        "ne yazik": -1.5, "harika": 2.6, "mukemmel": 2.8, "super": 2.2, "guzel": 1.8, "iyi": 1.4, "pratik": 1.8, "kolay": 1.6, "hizli": 1.4, "tesekkur": 0.6, "memnun": 2.0, "basarili": 2.0, "sorunsuz": 2.0,
        "kullanisli": 1.8, "begendim": 2.0, "seviyorum": 2.4, "tavsiye": 1.8, "efsane": 2.4, "muthis": 2.6, "rahat": 1.4, "sade": 1.0, "anlasilir": 1.4, "kurtuldum": 1.4, "basit": 1.0, "en iyi": 2.4, "hatasiz": 1.5,
        "rahatsiz": -1.5, "eksiksiz": 1.2, "iyi gunler": 0.0, "iyi calismalar": 0.0, "iyi aksamlar": 0.0, "kolay gelsin": 0.0,
    },
    negations_before=frozenset(),
    negations_after=frozenset({"degil", "degildi"}),
    intensifiers={"cok": 1.3, "asiri": 1.5, "gercekten": 1.3, "cidden": 1.3, "son": 1.1, "resmen": 1.3, "fazla": 1.2, "bayagi": 1.2, "hic": 1.3},
    by_prefix=True,
    boilerplate=(
        "Merhaba", "Merhabalar, iyi günler", "İyi çalışmalar", "Kolay gelsin", "Teşekkürler", "Teşekkür ederim, iyi çalışmalar", "Saygılarımla, Ayşe", "Lütfen acilen çözün.", "Çok sinir bozucu.", "Dönüşünüzü bekliyorum.",
        "Yardımcı olursanız sevinirim.", "Mağdur durumdayım.", "Değerlendirirseniz sevinirim.", "Yol haritanızda var mı?", "Her gün öğle yemeğinde kullanıyorum.", "Şirketimiz geçen ay bu karta geçti.", "Yaklaşık iki yıldır kullanıcınızım.",
        "Emeği geçenlere teşekkürler!", "Başarılar!", "5 yıldızı hak ediyor.", "Başka bir sorun yok.", "Çözüm bekliyorum.", "Rezalet.", "Berbat.", "Telefon numaram [phone], beni arayabilirsiniz.", "E-posta adresim [email].", "Bu konuda bilgi verir misiniz?",
    ),
    cues={
        "bug": (r"calism(iyor|adi|az)", r"acilmi", r"okutmu", r"okumu", r"gecmi(yor|di)", r"yuklenm(edi|iyor)", r"baglanmi", r"gelmi(yor|di)", r"donuyor|donmus|donma", r"cok(uyor|tu)", r"kapaniyor", r"\bhata", r"\bsorun(?!suz)", r"\bproblem", r"yavas", r"takil", r"\bbug", r"dus(med|mu)", r"gorunmu", r"yanlis", r"giremiyorum", r"yansimadi", r"iki (kez|kere)", r"zaman asimi", r"cekildi"),
        "feature_request": (r"eklen(meli|se|ir mi|mesi|irse|sin)", r"\bolsa\b", r"olsa (cok|harika|iyi)", r"keske", r"isti(yoruz|yorum)|isterdim|isterim", r"ozellik", r"secenek", r"olmali", r"lutfen ekle", r"entegrasyon", r"destekle", r"kullanilabilse", r"gecerli olsa", r"eklenebilse", r"harika olur"),
        "pricing": (r"ucret", r"komisyon", r"kesinti", r"aidat", r"pahali", r"fiyat"),
    },
    stop=tuple(
        """
        acaba ama ancak artık aslında az bana bazı belki ben beni benim bile bir biraz birçok biri birkaç birşey biz bize bizi bizim bu buna bunda bundan bunu bunun burada bütün çok çünkü da daha
        de defa değil diye dolayı en eğer gibi hala hatta hem hemen hep hepsi her herhangi herkes hiç için ile ilgili ise işte kadar kendi kez ki kim mı mi mu mü nasıl ne neden nerede nereye niçin niye
        o olan olarak oldu olduğu olsa olsun olup olur olursa on ona ondan onlar onu onun orada öyle pek rağmen sadece sanki sen siz size sizin şey şeyi şekilde şimdi şu şuna şunu tabi tam tüm üzere ve
        veya ya yani yine yok zaten zira lütfen gerçekten cidden hâlâ yapıyorum yaptım yapmak etmek ediyorum ettim oluyor olmuyor olması var uygulama uygulamada uygulamayı uygulamanın uygulaması app
        """.split()
    ),
)


def language(code: str) -> Language:
    try:
        return {"en": ENGLISH, "tr": TURKISH}[code]
    except KeyError:
        raise ValueError(f"unknown language {code!r}") from None


def plain_letters(text: str) -> str:
    return text.translate(str.maketrans("çğıöşüâîûÇĞİÖŞÜ", "cgiosuaiuCGIOSU"))


def with_plain_variants(texts: tuple[str, ...]) -> tuple[str, ...]:
    """The texts and, after them, those that differ when typed without accents."""
    return texts + tuple(p for t in texts if (p := plain_letters(t)) != t)


def stop_words(lang: Language, more: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Spark's English list, the language's own words in both spellings, and what the caller adds."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(sorted({*StopWordsRemover.loadDefaultStopWords("english"), *with_plain_variants(lang.stop), *more}))
