"""Value tables of the rule engine."""

from __future__ import annotations

# Title patterns in order of priority and the category each stands for.
TITLE_RULES: tuple[tuple[str, str], ...] = (
    (r"a-?traktor|epatraktor", "fordon/atraktor"),
    (r"husbil|integrerad husbil", "fordon/husbil-husvagn"),
    (r"husvagn|husvagnar|campingvagn", "fordon/husbil-husvagn"),
    (r"sk[åa]pbil|sk[åa]psbil|transportbil|pickup|budbil|servicebil", "fordon/transportbil"),
    (r"lastbil|dragbil|lastv[äa]xlare|tippbil|kranbil|flakbil|lastbilar", "fordon/lastbil-buss"),
    (r"minibuss|\bbuss", "fordon/lastbil-buss"),
    (r"sl[äa]pvagn|sl[äa]pk[äa]rra|\btrailer|sl[äa]pk|\bsl[äa]p\b|b[åa]tvagn", "fordon/slap-trailer"),
    (r"motorcykel|\bmc\b|\bmoped|scooter|vespa|fyrhjuling|\batv\b|sn[öo]skoter|snöscoter|crosshoj", "fordon/mc-moped-atv"),
    (r"d[äa]ck|f[äa]lg|bildel|stötf[åa]ngare|bilstereo|\breservdel|avgassystem|kamrem|piggkedjor|sn[öo]kedjor|dragkrok", "fordon/bildelar"),
    (r"personbil|\bsuv\b|halvkombi|st[äa]tionsvagn|cabriolet|\bsedan\b|\bkombi\b|laddhybrid|elbil|\bsaloon\b|veteranbil", "fordon/personbilar"),
    (r"\b(volvo|volkswagen|\bvw\b|audi|\bbmw|mercedes|toyota|\bkia\b|hyundai|skoda|\bford\b|renault|peugeot|nissan|tesla|porsche)\b", "fordon/personbilar"),
    (r"utombordare|utombordsmotor|inombordare|b[åa]tmotor|utombords", "bat/batmotor"),
    (r"flytv[äa]st|r[äa]ddningsv[äa]st|b[åa]ttillbeh[öo]r|f[öo]rt[öo]jning|\bankare|b[åa]tdel|b[åa]tkapell|akterspegel", "bat/battillbehor"),
    (r"motorb[åa]t|segelb[åa]t|daycruiser|roddb[åa]t|gummib[åa]t|\bjolle|vattenskoter|\bb[åa]t\b|b[åa]tar|snipa|\bkajak|\bkanot", "bat/batar"),
    (r"gr[äa]vmaskin|minigr[äa]v|hjulgr[äa]v|b[äa]ltegr[äa]v|gr[äa]vlastare|\bdumper|bandgr[äa]v", "entreprenad/gravmaskin-lastare"),
    (r"hjullastare|lastmaskin|hjulladdare|kompaktlastare|redskapsb[äa]rare|minilastare", "entreprenad/gravmaskin-lastare"),
    (r"gaffeltruck|motviktstruck|st[åa]truck|ledstaplare|\btruck|skjutstativtruck", "entreprenad/truck"),
    (r"industrimaskin|verkstadsmaskin|\bcnc|pelarborr|metallsvarv|kantpress|plasmask[äa]r|generator|elverk", "entreprenad/industri-verkstad"),
    (r"entreprenad|\bskopa|planeringsskopa|smalskopa|grusskopa|palletgafflar|redskapsf[äa]ste", "entreprenad/redskap"),
    (r"skogsmaskin|sk[öo]rdare|\bskotare|vedklyv|vedmaskin|timmerv[äa]gn|flishugg|motors[åa]g", "lantbruk/skogsmaskin"),
    (r"traktor", "lantbruk/traktor"),
    (r"\bharv|\bpl[öo]g|s[åa]maskin|g[öo]dselspridare|balpress|tallriksredskap|vallsk[öo]rd|jordbearbet|gr[öo]dor", "lantbruk/jordbruk"),
    (r"gr[äa]sklippare|[åa]kgr[äa]sklippare|robotgr[äa]sklippare|\btrimmer|l[öo]vbl[åa]s|jordfr[äa]s|sn[öo]slunga|gr[öo]nyta", "lantbruk/gronyta"),
    (r"kompressor|luftkompressor|h[öo]gtryckstv[äa]tt|dr[äa]nkbar pump|vattenpump|\bpump\b", "verktyg/kompressor-pump"),
    (r"\bsvets|verktygsvagn|verktygssk[åa]p|arbetsb[äa]nk|skruvst[äa]d|b[äa]nkslip|slipmaskin|slipsten", "verktyg/verkstad"),
    (r"borrmaskin|vinkelslip|cirkels[åa]g|sticks[åa]g|kaps[åa]g|skruvdragare|mutterdragare|handverktyg|hylsnyckel|\bverktyg|slagborr|mejsel|hyvel|listhyvel|f[äa]rgspruta|h[öo]gtryckspruta|spikpistol|tigers[åa]g|trappstege|arbetsbock|\bstege\b|batteri.*(milwaukee|makita|bosch|dewalt|hilti|ryobi)|\bslipband", "verktyg/handverktyg"),
    (r"\bkakel|klinker|\bgolv|parkett|laminatgolv|badrum|\bdusch|handfat|toalett|blandare|\bwc\b|badkar|kommod", "bygg/golv-kakel-bad"),
    (r"byggmaterial|gipsskiva|reglar|\bvirke|isolering|takpl[åa]t|taksten|takstege|armering|\bbetong|c-profil|lagervara|\bplank|skruv|\bbult\b|\bmutter|\bspik\b|inf[äa]stning|g[åa]ngj[äa]rn|\bbeslag|ytterd[öo]rr|innerd[öo]rr|paneld[öo]rr|\bd[öo]rr\b|karmm[åa]tt", "bygg/byggmaterial"),
    (r"tr[äa]dg[åa]rd|pergola|utem[öo]bel|utem[öo]bl|v[äa]xthus|\bstaket|uteplats|\bgrill|markis|studsmatta|sols[äa]ng|vils[äa]ng|grensax|sekat[öo]r|h[äa]cksax", "bygg/tradgard"),
    (r"armbandsur|\bfickur|herrur|damur|v[äa]ggur|golvur|bordsur|\brolex|\bomega\b|tag heuer|\bpatek|breitling|longines|\bseiko|tissot|chronograf|\bur i guld", "smycken/klockor"),
    (r"diamantring|f[öo]rlovningsring|vigselring|guldring|\bring\b|\bringar", "smycken/smycken-sub"),
    (r"halsband|halskedja|guldkedja|silverkedja|collier|\barmband|[öo]rh[äa]nge|berlock|\bh[äa]nge|\bsmycke|\bbrosch|manschettknapp|\bkedja i guld", "smycken/smycken-sub"),
    (r"guldtacka|silvertacka|guldmynt|[äa]delsten|\bsafir|\brubin|smaragd|vitguld|r[öo]dguld|18k|14k|925 silver|\bbriljant|nysilver|silverbestick|silversked|silverfat|silverskål", "smycken/guld-silver"),
    (r"frim[äa]rke|frim[äa]rkssamling|\bmaerker\b|briefmarke", "samla/frimarken"),
    (r"mynt\b|\bsedel\b|sedlar|numismatik|myntsamling|\bmedalj|\bpolletter", "samla/mynt"),
    (r"oljem[åa]lning|oljor? p[åa] duk|akvarell|litografi|\btavla|tavlor|\bm[åa]lning|konstverk|skulptur|\betsning|serigrafi|\bsignerad|gouache|\bblyerts|\bteckning|\bpastell|tr[äa]snitt|\bmaleri|oil on canvas|oil painting|\bpainting|watercolo|lithograph|\bsculpture|\bgem[äa]lde|\bgrafik|collage|vy [öo]ver", "konst/konst-tavlor"),
    (r"orientmatta|persisk matta|\bkelim|\brya\b|handkn[uy]ten|\bmatta\b|mattor|\bteppich|\bcarpet|\brug\b", "konst/mattor"),
    (r"antikvitet|\bantik\b|1600-tal|1700-tal|1800-tal|gustaviansk|allmoge|\bbarock|\brokoko|jugend", "konst/antikt"),
    (r"taklampa|golvlampa|bordslampa|bordlampe|gulvlampe|ljuskrona|takkrona|kristallkrona|\blampa|\blampor|\bpendel|v[äa]gglampa|belysning|armatur|lysestage", "mobler/belysning"),
    (r"porslin|servis|kristall|\bvas\b|\bvaser|karaff|keramik|stengods|kosta boda|orrefors|r[öo]rstrand|gustavsberg|\bterrin|\bkarott|\bfat\b|tallrik|glas\b|glasbruk|snapsglas|vinglas|champagneglas|dricksglas|[öo]lglas|\bremmare|\bpokal|\bskål\b|figurin|\bbowl\b", "mobler/porslin-glas"),
    (r"\bspegel|speglar|spegelram", "mobler/prydnad"),
    (r"\bsoffa|\bsofa\b|f[åa]t[öo]lj|matbord|soffbord|\bs[äa]ng\b|byr[åa]|garderob|bokhylla|\bsk[äa]nk|vitrin|matgrupp|\bstol\b|\bstolar|\bbord\b|sekret[äa]r|kommod|pinnstol|karmstol|h[öo]rnsk[åa]p|kl[äa]dsk[åa]p|pl[åa]tsk[åa]p|st[åa]lsk[åa]p|lampbord|avlastningsbord|sidobord|tv-?b[äa]nk|tv-?bord|mediab[äa]nk", "mobler/mobler-sub"),
    (r"kylsk[åa]p|\bkyl\b|\bfrys\b|tv[äa]ttmaskin|torktumlare|diskmaskin|\bspis\b|\bugn\b|mikrov[åa]gsugn|vitvaror|induktionsh[äa]ll|kokplatta", "hem/vitvaror"),
    (r"kastrull|stekpanna|k[öo]ksredskap|\bbestick|husger[åa]d|kaffebryggare|kaffemaskin|espressomaskin|\bmixer|matberedare|glassmaskin|\bblender", "hem/husgerad-kok"),
    (r"pallst[äa]ll|lagerhylla|f[öo]rvaringssk[åa]p|hyllst[äa]ll|f[öo]rvaring|\bhylla|hyllor|\bskohylla", "hem/forvaring"),
    (r"3d-?skrivare|3d-?printer|3d printer", "elektronik/datorer"),
    (r"\bdator(?!spel)|\blaptop|b[äa]rbar dator|station[äa]r|bildsk[äa]rm|\bsk[äa]rm|tangentbord|\bskrivare|\bserver|\brouter|\bswitch\b|n[äa]tverk", "elektronik/datorer"),
    (r"\bkamera|systemkamera|objektiv|\bcanon\b|\bnikon\b|dr[öo]nare|\bgopro|\bblixt\b|hasselblad", "elektronik/foto"),
    (r"\btv\b(?!-?(spel|b[äa]nk|bord))|television|h[öo]gtalare|f[öo]rst[äa]rkare|receiver|soundbar|hemmabio|\bstereo|skivspelare|vinylspelare|\bradio", "elektronik/ljud-bild-tv"),
    (r"\bmobil|smartphone|\biphone|surfplatta|\bipad\b|samsung galaxy", "elektronik/mobil"),
    (r"dykutrustning|dykset|dykdr[äa]kt|v[åa]tdr[äa]kt|torrdr[äa]kt|dykflaska|simf[öo]tter|snorkel|paddleboard|\bsup\b|windsurf|wakeboard", "sport/vattensport"),
    (r"l[öo]pband|crosstrainer|motionscykel|spinningcykel|skivst[åa]ng|\bhantlar|tr[äa]ningsmaskin|benpress|multigym|\bgym\b|romaskin|magb[äa]nk|träningsb[äa]nk", "sport/gym"),
    (r"mountainbike|\belcykel|racercykel|\bcykel|cyklar", "sport/cykel"),
    (r"\bjakt|vapensk[åa]p|kikarsikte|\bfiske|fiskesp[öo]|kastsp[öo]|\bt[äa]lt|s[öo]vs[äa]ck|friluft|\bskidor|snowboard", "sport/jakt-fiske"),
    (r"fris[öo]r|beh[äa]ndlingsb[äa]nk|sk[öo]nhetssalong|solarium|frisörvagn|nagelbord", "restaurang/frisor-skonhet"),
    (r"storkök|proffsk[öo]k|kombiugn|kyldisk|frysdisk|storkoksutrustning|serveringsvagn|\bproffs", "restaurang/restaurang-storkok"),
    (r"kontorsm[öo]bler|kontorsstol|skrivbord|konferensbord|kontorssk[åa]p", "restaurang/kontor"),
    (r"butiksinredning|kassadisk|butikshyll|skyltdocka|kl[äa]dst[äa]ll|butiksdisk|klädställning", "restaurang/butik"),
    (r"parfym|eau de (?:toilette|parfum)|\bdoft\b|aftershave", "skonhet/parfym"),
    (r"\bsmink|make-?up|l[äa]ppstift|mascara|foundation|[öo]gonskugga|nagellack|highlighter", "skonhet/smink"),
    (r"hudv[åa]rd|ansiktskr[äa]m|\bserum\b|schampo|\bbalsam\b|h[åa]rv[åa]rd|body lotion|ansiktsmask", "skonhet/hudvard"),
    (r"barnkl[äa]der|barnskor|babykl[äa]der|\bbody\b.*barn|barnjacka", "klader/barnklader"),
    (r"handv[äa]sk|resv[äa]sk|ryggs[äa]ck|louis vuitton|\bgucci|\bv[äa]ska|v[äa]skor|plånb[öo]|\bkoffert", "klader/vaskor"),
    (r"solglas[öo]gon|\bb[äa]lte|\bsjal\b|accessoar|\bscarf", "klader/accessoarer"),
    (r"jacka|\bkappa|kl[äa]nning|\bkostym|\bskor\b|k[äa]ng|\bst[öo]vlar|\bkl[äa]der|\bpäls|byxor|tr[öo]ja|skjorta|kalsonger|underkl[äa]der|\bstrumpor", "klader/klader-skor"),
    (r"""vinyl|lp-?skiva|vinylskiva|grammofonskiva|\b7"?-?singel|\blp-?box""", "media/vinyl"),
    (r"\bcd-?skiva|\bcd-?box|musikkassett|kassettband|\bmc-?band", "media/cd-kassett"),
    (r"\bdvd\b|blu-?ray|\bvhs\b|laserdisc|filmsamling", "media/film"),
    (r"tv-?spel|datorspel|nintendo|playstation|\bxbox|\bnes\b|\bsnes\b|game ?boy|gamecube|\bwii\b|\bps[1-5]\b|megadrive|mega drive|dreamcast|sega (?:mega|master|saturn|genesis)|spelkassett|game genie", "media/tvspel"),
    (r"spelkonsol|\bkonsol\b|handkontroll|arkadspel|arkadmaskin|pinball|flipperspel|jukebox", "media/konsol"),
    (r"serietidning|seriealbum|seriemagasin|\bfantomen\b|kalle anka|\bbamse\b|\btintin\b|mangaalbum|\bmanga\b", "samla/serietidningar"),
    (r"veckotidning|\btidning|\bmagasin\b|[åa]rg[åa]ng.*(tidning|magasin)", "bocker/tidningar"),
    (r"\bkarta\b|\bkartor\b|sj[öo]kort|kopparstick|litografisk karta", "bocker/kartor-tryck"),
    (r"\bbok\b|b[öo]cker|f[öo]rstautg[åa]va|antikvariat|bokverk|\binbunden|bibel\b", "bocker/bocker-sub"),
    (r"samlarkort|\btcg\b|pok[eé]mon-?kort|magic the gathering|hockeykort|fotbollskort|\bpanini", "samla/samlarkort"),
    (r"militaria|\buniform|hj[äa]lm m/|\bbajonett|\bordnar\b|\bregemente|milit[äa]r.*(hj[äa]lm|k[åa]rd|medalj)", "samla/militaria"),
    (r"vykort|\bansiktskort|\bstereobild", "samla/vykort"),
    (r"gitarr|\bpiano|\bflygel|\bfiol|trumset|keyboard|\bsynt\b|musikinstrument|dragspel|\bbanjo|\bcello\b", "samla/instrument"),
    (r"modellbygge|modellbil|modellflyg|skalmodell|\bairfix|warhammer|diecast|byggsats.*modell", "samla/modell-hobby"),
    (r"\blego\b|barbie|br[äa]dspel|\bpussel|\bleksak|docksk[åa]p|\bnalle\b|gosedjur|actionfigur|playmobil|\bbrio\b", "samla/leksaker"),
    (r"vintage|\bretro\b|samlarobjekt|emaljskylt|nostalgi|reklamskylt", "samla/vintage"),
    (r"\bh[äa]st\b|ridutrustning|\bsadel|hoppsadel|schabrak|\bgrimma|\bbetsel|ridsport", "djur/hastsport"),
    (r"hundbur|kattträd|akvarium|djurtillbeh[öo]r|hundgrind|\bfoder", "djur/djurtillbehor"),
)

# Source category names and the category each stands for, first match first.
NAME_RULES: tuple[tuple[str, str], ...] = (
    (r"seri(er|e|magasin)|\bmarvel\b|\bdc\b|disney|fantomen|\bmanga|\bbamse\b|superhj[äa]lte|graphic novel|illustrerade klassiker|\btintin", "samla/serietidningar"),
    (r"^\s*fordon\s*$", "fordon/personbilar"),
    (r"^\s*musik\s*$", "media/vinyl"),
    (r"^\s*konst\s*$", "konst/konst-tavlor"),
    (r"^\s*antikt\b", "konst/antikt"),
    (r"hemelektronik", "elektronik/ljud-bild-tv"),
    (r"fordonsdelar", "fordon/bildelar"),
    (r"^\s*sk[öo]nhet\s*$", "skonhet/hudvard"),
    (r"konsthantverk|handgjort", "mobler/prydnad"),
    (r"accessoarer", "klader/accessoarer"),
    (r"hem & hush[åa]ll|hush[åa]lls|k[öo]ksmaskin|vitvara", "hem/husgerad-kok"),
    (r"verktyg", "verktyg/handverktyg"),
    (r"tidning|tidskrift|magasin", "bocker/tidningar"),
    (r"b[öo]cker|\broman|deckar|\bfantasy\b|skr[äa]ck|thriller|\bpocket|litteratur|biografi|faktab|kokb|barnb|ungdomsb|kapitelb|bilderb|sm[åa]barnsb|reparationsb|instruktionsb|historieb|\bsagor|\blyrik|poesi|antikvariat|\bbibel", "bocker/bocker-sub"),
    (r"\bkartor?\b|sj[öo]kort|kopparstick", "bocker/kartor-tryck"),
    (r"vinyl|\blp-?(skiva|box)?\b|grammofon|\brock\b|h[åa]rdrock|\bpop\b|\bjazz\b|\bblues\b|\bpunk\b|\bmetal\b|hip.?hop|\bsoul\b|reggae|\bcountry\b|schlager|dansband|folkmusik|klassisk musik|\balbum\b|singel", "media/vinyl"),
    (r"\bcd-?(skiva|box)?\b|kassettband|musikkassett", "media/cd-kassett"),
    (r"\bdvd\b|blu-?ray|\bvhs\b|familjefilm|tv-serie|\bfilmer\b|laserdisc", "media/film"),
    (r"tv-?spel|datorspel|nintendo|playstation|\bxbox\b|\bsega\b|spelkassett", "media/tvspel"),
    (r"spelkonsol|\bkonsol\b|arkadspel|handkontroll", "media/konsol"),
    (r"oljem[åa]ln|akvarell|litografi|\btavl|\bm[åa]lning|skulptur|\bgrafik\b|konstverk|\betsning|serigrafi", "konst/konst-tavlor"),
    (r"orientmatta|\bmatta\b|mattor|\bkelim|\brya\b", "konst/mattor"),
    (r"antikvitet|allmoge|gustaviansk", "konst/antikt"),
    (r"frim[äa]rke", "samla/frimarken"),
    (r"\bmynt\b|\bsedel\b|sedlar|numismat|polletter|\bmedalj", "samla/mynt"),
    (r"vykort|\bansiktskort", "samla/vykort"),
    (r"samlarkort|\btcg\b|pok[eé]mon.?kort|hockeykort|fotbollskort", "samla/samlarkort"),
    (r"militaria|\buniform|\bbajonett|\bordnar\b|milit[äa]r", "samla/militaria"),
    (r"stickning|s[öo]mnad|\btyger\b|\bgarn\b|virkning|broderi|handarbete|\bpyssel|sytillbeh|symaskin", "samla/modell-hobby"),
    (r"modellbygg|modellbil|modellflyg|skalmodell|\bairfix|warhammer|diecast", "samla/modell-hobby"),
    (r"leksak|\blego\b|barbie|\bdocka\b|dockor|gosedjur|\bnalle\b|actionfigur|playmobil|\bbrio\b", "samla/leksaker"),
    (r"samlarobjekt|samlarsak|reklamskylt|emaljskylt|nostalgi|\bretro\b|vintage", "samla/vintage"),
    (r"musikinstrument|\bgitarr|\bpiano\b|\bfiol\b|trumset|dragspel", "samla/instrument"),
    (r"parfym|\bdoft\b|eau de", "skonhet/parfym"),
    (r"\bsmink|make-?up|l[äa]ppstift|mascara|nagellack", "skonhet/smink"),
    (r"hudv[åa]rd|ansiktskr[äa]m|h[åa]rv[åa]rd|schampo", "skonhet/hudvard"),
    (r"grafikkort|\bgpu\b|h[åa]rddisk|processor|\bcpu\b|moderkort|\bssd\b|minne \(ram|b[äa]rbar dator|\bdator\b|laptop|tangentbord|bildsk[äa]rm", "elektronik/datorer"),
    (r"vinylspelare|skivspelare|\bstereo|f[öo]rst[äa]rkare|h[öo]gtalare|receiver|soundbar|hemmabio", "elektronik/ljud-bild-tv"),
    (r"mobiltelefon|smartphone|\biphone|surfplatta|\bipad\b|smartwatch|wearable", "elektronik/mobil"),
    (r"systemkamera|\bobjektiv\b|kamerahus|\bblixt\b|\bkameror\b|analog.*kamera|digitalkamera", "elektronik/foto"),
    (r"ram-?minne|arbetsminne", "elektronik/datorer"),
    (r"armbandsur|\bfickur\b|\bv[äa]ggur|herrur|damur|\bklockor\b|quartzklock|kvartsur|\bur\b", "smycken/klockor"),
    (r"\bhalsband|\bring\b|\bringar\b|[öo]rh[äa]ng|\bbrosch|\bsmycke|\barmband\b", "smycken/smycken-sub"),
    (r"[äa]delsten|\bdiamant|\bsafir|\brubin|smaragd|guldtacka|silvertacka", "smycken/guld-silver"),
    (r"kl[äa]nning|\bbyxor|\bjacka|\btr[öo]ja|skjorta|\bkjol\b|\bkostym|kl[äa]der|underkl[äa]der", "klader/klader-skor"),
    (r"\bskor\b|\bst[öo]vlar|sneakers|\bk[äa]ngor|sandaler", "klader/klader-skor"),
    (r"handv[äa]sk|\bv[äa]ska\b|v[äa]skor|pl[åa]nbok|resv[äa]sk|ryggs[äa]ck", "klader/vaskor"),
    (r"barnkl[äa]der|barnskor|babykl", "klader/barnklader"),
    (r"gustavsberg|r[öo]rstrand|\bkosta\b|orrefors|porslin|\bservis\b|kristall|keramik|stengods|\bvas\b", "mobler/porslin-glas"),
    (r"\bsoffa|f[åa]t[öo]lj|matbord|\bstol\b|byr[åa]|garderob|bokhylla|s[äa]ng\b", "mobler/mobler-sub"),
    (r"taklampa|golvlampa|bordslampa|ljuskrona|\blampa\b|belysning", "mobler/belysning"),
    (r"bildel|d[äa]ck|\bf[äa]lg|reservdel|stötf[åa]ngare|avgassystem", "fordon/bildelar"),
    (r"\bcykel\b|mountainbike|elcykel", "sport/cykel"),
    (r"\bjakt\b|\bfiske\b|fiskesp[öo]|friluft", "sport/jakt-fiske"),
    (r"tr[äa]ningsmaskin|l[öo]pband|\bhantlar|\bgym\b", "sport/gym"),
    (r"tr[äa]dg[åa]rd|v[äa]xthus|gr[äa]sklippare", "bygg/tradgard"),
)

# Fixed values: (main key, main label, sub key, sub label).
TAXONOMY: tuple[tuple[str, str, str, str], ...] = (
    ("fordon", "Fordon", "personbilar", "Personbilar"),
    ("fordon", "Fordon", "transportbil", "Transport & Skåpbil"),
    ("fordon", "Fordon", "lastbil-buss", "Lastbil & Buss"),
    ("fordon", "Fordon", "mc-moped-atv", "MC, Moped & ATV"),
    ("fordon", "Fordon", "slap-trailer", "Släp & Trailer"),
    ("fordon", "Fordon", "husbil-husvagn", "Husbil & Husvagn"),
    ("fordon", "Fordon", "atraktor", "A-traktor"),
    ("fordon", "Fordon", "bildelar", "Bildelar, Däck & Tillbehör"),
    ("bat", "Båt & Marint", "batar", "Båtar"),
    ("bat", "Båt & Marint", "batmotor", "Motorer"),
    ("bat", "Båt & Marint", "battillbehor", "Båttillbehör & Säkerhet"),
    ("entreprenad", "Entreprenad & Industri", "gravmaskin-lastare", "Grävmaskiner & Lastare"),
    ("entreprenad", "Entreprenad & Industri", "truck", "Truckar"),
    ("entreprenad", "Entreprenad & Industri", "industri-verkstad", "Industri & Verkstad"),
    ("entreprenad", "Entreprenad & Industri", "redskap", "Redskap & Utrustning"),
    ("lantbruk", "Lantbruk & Skog", "traktor", "Traktorer"),
    ("lantbruk", "Lantbruk & Skog", "skogsmaskin", "Skogsmaskiner"),
    ("lantbruk", "Lantbruk & Skog", "jordbruk", "Jordbruksredskap"),
    ("lantbruk", "Lantbruk & Skog", "gronyta", "Grönyta & Trädgårdsmaskiner"),
    ("verktyg", "Verktyg & Maskiner", "handverktyg", "Hand- & Elverktyg"),
    ("verktyg", "Verktyg & Maskiner", "verkstad", "Verkstadsutrustning"),
    ("verktyg", "Verktyg & Maskiner", "kompressor-pump", "Kompressorer & Pumpar"),
    ("bygg", "Bygg & Trädgård", "byggmaterial", "Byggmaterial"),
    ("bygg", "Bygg & Trädgård", "golv-kakel-bad", "Golv, Kakel & Badrum"),
    ("bygg", "Bygg & Trädgård", "tradgard", "Trädgård & Uteplats"),
    ("konst", "Konst & Antikt", "konst-tavlor", "Konst & Tavlor"),
    ("konst", "Konst & Antikt", "antikt", "Antikt"),
    ("konst", "Konst & Antikt", "design-retro", "Design & Retro"),
    ("konst", "Konst & Antikt", "mattor", "Mattor"),
    ("smycken", "Smycken, Guld & Klockor", "smycken-sub", "Smycken"),
    ("smycken", "Smycken, Guld & Klockor", "klockor", "Armbandsur & Klockor"),
    ("smycken", "Smycken, Guld & Klockor", "guld-silver", "Guld, Silver & Ädelstenar"),
    ("mobler", "Möbler & Inredning", "mobler-sub", "Möbler"),
    ("mobler", "Möbler & Inredning", "belysning", "Belysning"),
    ("mobler", "Möbler & Inredning", "porslin-glas", "Porslin, Glas & Keramik"),
    ("mobler", "Möbler & Inredning", "prydnad", "Prydnad & Inredning"),
    ("hem", "Hem & Hushåll", "vitvaror", "Vitvaror"),
    ("hem", "Hem & Hushåll", "husgerad-kok", "Husgeråd & Kök"),
    ("hem", "Hem & Hushåll", "forvaring", "Förvaring & Hyllor"),
    ("elektronik", "Data & Elektronik", "datorer", "Datorer & Kringutrustning"),
    ("elektronik", "Data & Elektronik", "ljud-bild-tv", "Ljud, Bild & TV"),
    ("elektronik", "Data & Elektronik", "mobil", "Mobil & Telefoni"),
    ("elektronik", "Data & Elektronik", "foto", "Foto & Kamera"),
    ("sport", "Sport & Fritid", "gym", "Gym & Träning"),
    ("sport", "Sport & Fritid", "cykel", "Cykel"),
    ("sport", "Sport & Fritid", "vattensport", "Vattensport & Dyk"),
    ("sport", "Sport & Fritid", "jakt-fiske", "Jakt, Fiske & Friluft"),
    ("sport", "Sport & Fritid", "camping", "Camping"),
    ("restaurang", "Restaurang, Butik & Kontor", "restaurang-storkok", "Restaurang & Storkök"),
    ("restaurang", "Restaurang, Butik & Kontor", "butik", "Butik & Butiksinredning"),
    ("restaurang", "Restaurang, Butik & Kontor", "kontor", "Kontor"),
    ("restaurang", "Restaurang, Butik & Kontor", "frisor-skonhet", "Frisör & Skönhet"),
    ("klader", "Kläder, Mode & Accessoarer", "klader-skor", "Kläder & Skor"),
    ("klader", "Kläder, Mode & Accessoarer", "barnklader", "Barnkläder & Barnskor"),
    ("klader", "Kläder, Mode & Accessoarer", "vaskor", "Väskor"),
    ("klader", "Kläder, Mode & Accessoarer", "accessoarer", "Accessoarer"),
    ("skonhet", "Skönhet & Hälsa", "parfym", "Parfym & Doft"),
    ("skonhet", "Skönhet & Hälsa", "smink", "Smink & Makeup"),
    ("skonhet", "Skönhet & Hälsa", "hudvard", "Hudvård & Hår"),
    ("media", "Musik, Film & Spel", "vinyl", "Vinyl"),
    ("media", "Musik, Film & Spel", "cd-kassett", "CD & Kassett"),
    ("media", "Musik, Film & Spel", "film", "Film & DVD"),
    ("media", "Musik, Film & Spel", "tvspel", "TV- & Datorspel"),
    ("media", "Musik, Film & Spel", "konsol", "Spelkonsoler"),
    ("bocker", "Böcker & Tidningar", "bocker-sub", "Böcker"),
    ("bocker", "Böcker & Tidningar", "tidningar", "Tidningar & Magasin"),
    ("bocker", "Böcker & Tidningar", "kartor-tryck", "Kartor & Tryck"),
    ("samla", "Samla & Hobby", "mynt", "Mynt & Sedlar"),
    ("samla", "Samla & Hobby", "frimarken", "Frimärken"),
    ("samla", "Samla & Hobby", "serietidningar", "Serietidningar"),
    ("samla", "Samla & Hobby", "samlarkort", "Samlarkort & Kort"),
    ("samla", "Samla & Hobby", "militaria", "Militaria"),
    ("samla", "Samla & Hobby", "vykort", "Vykort & Bilder"),
    ("samla", "Samla & Hobby", "instrument", "Musikinstrument"),
    ("samla", "Samla & Hobby", "modell-hobby", "Modell & Hobby"),
    ("samla", "Samla & Hobby", "leksaker", "Leksaker"),
    ("samla", "Samla & Hobby", "vintage", "Vintage & Samlarobjekt"),
    ("djur", "Djur & Lantliv", "hastsport", "Hästsport & Ridutrustning"),
    ("djur", "Djur & Lantliv", "djurtillbehor", "Djurtillbehör"),
    ("ovrigt", "Blandat & Övrigt", "partier", "Blandat & Partier"),
    ("ovrigt", "Blandat & Övrigt", "varuparti", "Varuparti & Konkurslager"),
    ("ovrigt", "Blandat & Övrigt", "diverse", "Diverse & Ej klassat"),
)

# Signals of a typeless mixed lot, and house categories that say nothing.
MIXED_SIGNAL = r"blandl[åa]d|\bd[öo]dsbo|diverse f[öo]rem|diverse saker|diverse prylar|blandat inneh[åa]ll|blandade f[öo]rem|flyttlass|\bdiverse\b|mixed lot|job lot"
CATCH_ALL = r"^(övrigt|ovrigt|diverse|varuparti|konkurslager|blandat|other|misc)"
MIXED, UNSORTED = "ovrigt/partier", "ovrigt/diverse"

# Words that carry no category signal.
STOP_WORDS = (
    "och", "med", "för", "från", "samt", "utan", "till", "the", "and",
    "st", "styck", "stycken", "par", "set", "div", "diverse", "objekt",
    "auktion", "parti", "obs", "inkl", "exkl", "cirka", "över", "under",
    "stl", "strl", "storlek", "bredd", "höjd", "hojd", "längd", "langd",
    "djup", "diameter", "vikt", "mått", "matt", "gram", "skick", "nyskick",
    "begagnad", "begagnat", "oanvänd", "oanvänt", "fungerande", "testad",
)

# Confidence sources, strongest first.
CONFIDENCE_RANK = {"human": 6, "llm": 5, "learned": 4, "house": 3, "text": 2, "mixed": 1, "none": 0}

# Rates of the sort order and the deal flag, SEK for one unit.
SORT_RATES = {"GBP": 12.8, "EUR": 11.1, "DKK": 1.48, "USD": 9.7, "NOK": 0.98, "CHF": 12.0}

# Condition badges, and foreign spellings of cities.
CONDITION_NEW = r"(ny/oanvänd|oanvänd\M|oanvänt\M|oanvända\M|ny i (kartong|förpackning|obruten)|nyskick)"
CONDITION_UNTESTED = r"(ej testa[dt]|otestad|ej funktionstestad|ej provkörd)"
CITY_NAMES = {
    "gothenburg": "Göteborg", "copenhagen": "Köpenhamn", "malmoe": "Malmö", "stockholm": "Stockholm",
    "munich": "München", "vienna": "Wien", "prague": "Prag", "brussels": "Bryssel", "cologne": "Köln",
    "warsaw": "Warszawa", "moscow": "Moskva", "athens": "Aten", "rome": "Rom", "lisbon": "Lissabon",
    "florence": "Florens", "venice": "Venedig", "zurich": "Zürich", "geneva": "Genève", "milan": "Milano",
    "naples": "Neapel", "helsinki": "Helsingfors", "the hague": "Haag", "gutenburg": "Göteborg",
}

# Fixed values: (house, currency, kind, premium rate, least premium, largest premium, lot fee, VAT on the premium,
# VAT % on a source's fee or None for the object's own, approximate, external without a fee). "*": any other currency.
FEE_MODELS: tuple[tuple, ...] = (
    ("tovek", "*", "source", None, None, None, None, None, 25.0, False, False),
    ("auctionet", "SEK", "percentage", 0.25, None, None, 80.0, 0.0, None, False, False),
    ("auctionet", "DKK", "percentage", 0.25, None, None, 70.0, 0.0, None, False, False),
    ("auctionet", "GBP", "percentage", 0.336, None, None, 5.0, 0.0, None, False, False),
    ("auctionet", "EUR", "percentage", 0.25, None, None, 8.0, 0.0, None, False, False),
    ("auctionet", "*", "percentage", 0.25, None, None, 0.0, 0.0, None, False, False),
    ("riksauktioner", "*", "percentage", 0.10, 100.0, 10000.0, None, 0.25, None, False, False),
    ("fabeo", "*", "source", None, None, None, None, None, 25.0, False, False),
    ("bukowskis", "EUR", "percentage", 0.25, None, None, 5.06, 0.0, None, False, False),
    ("bukowskis", "*", "percentage", 0.25, None, None, 50.0, 0.0, None, False, False),
    ("bna", "*", "percentage", 0.12, None, None, None, 0.25, None, False, False),
    ("klaravik", "*", "source", None, None, None, None, None, 0.0, False, False),
    ("blinto", "*", "source", None, None, None, None, None, 25.0, False, False),
    ("psauction", "*", "percentage", 0.16, None, None, None, 0.25, None, False, False),
    ("retrade", "*", "external", None, None, None, None, None, None, False, False),
    ("netauktion", "*", "percentage", 0.12, 100.0, 50000.0, None, 0.25, None, False, False),
    ("kronofogden", "*", "source", None, None, None, None, None, None, False, False),
    ("junora", "*", "source", None, None, None, None, None, 0.0, True, True),
    ("frivio", "*", "percentage", 0.05, None, None, None, 0.25, None, False, False),
    ("siko", "*", "percentage", 0.18, None, None, 28.0, 0.0, None, False, False),
    ("upplands", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("metropol", "*", "percentage", 0.25, None, None, 100.0, 0.0, None, False, False),
    ("pantbanken", "*", "percentage", 0.15, None, None, None, 0.0, None, False, False),
    ("budi", "*", "source", None, None, None, None, None, 25.0, False, True),
    ("vaxxa", "*", "source", None, None, None, None, None, 25.0, False, True),
    ("auktiona", "*", "source", None, None, None, None, None, 0.0, False, False),
    ("tradera", "*", "source", None, None, None, None, None, None, False, False),
    ("gak", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("auktionskammaren", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("sajab", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("effecta", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("effectamaskin", "*", "source", None, None, None, None, None, 0.0, False, True),
    ("haraldssons", "*", "source", None, None, None, None, None, 0.0, False, True),
)

# Knots (reserve price, fee) of the stepwise fee.
FEE_KNOTS = (
    (0, 130), (100, 130), (250, 130), (500, 265), (1000, 265), (2000, 265), (3000, 525), (4000, 525),
    (5500, 790), (7000, 790), (8000, 895), (9000, 1050), (11500, 1310), (14000, 1310), (16000, 1840), (18000, 1840),
    (20000, 2100), (24000, 2100), (25000, 2785), (28000, 2785), (32500, 3415), (40000, 3415), (50000, 4465), (60000, 4465),
    (65000, 5515), (97200, 5515), (108000, 6565), (120000, 6565), (160000, 7090), (200000, 7770), (225000, 8085),
    (490000, 12390), (2650000, 37485),
)

# The months as they are written short; a full name starts with its short one.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "nov": 11, "dec": 12}

# Category keys of one source and what each stands for.
HOUSE_KEYS = {
    "construction-home": "bygg/byggmaterial",
    "cars": "fordon/personbilar",
    "leisure-electronics": "elektronik/ljud-bild-tv",
    "construction": "entreprenad/gravmaskin-lastare",
    "forestry-agriculture": "lantbruk/traktor",
    "transport": "fordon/lastbil-buss",
    "caravan-motorhome": "fordon/husbil-husvagn",
    "business-operations": "restaurang/butik",
    "vehicle": "fordon/personbilar",
    "it": "elektronik/datorer",
}

# Patterns of category labels that no title pattern knows, in order.
LABEL_RULES: tuple[tuple[str, str], ...] = (
    (r"personbil|\bbilar\b", "fordon/personbilar"),
    (r"lastbil|\btransport\b", "fordon/lastbil-buss"),
    (r"\bkonst\b", "konst/konst-tavlor"),
    (r"m[öo]bler", "mobler/mobler-sub"),
    (r"smycken", "smycken/smycken-sub"),
    (r"elektronik|\bdata\b|\bit\b", "elektronik/datorer"),
    (r"entreprenad", "entreprenad/gravmaskin-lastare"),
    (r"lantbruk|jordbruk", "lantbruk/traktor"),
    (r"skogsbruk|\bskog\b", "lantbruk/skogsmaskin"),
    (r"\bverktyg\b", "verktyg/handverktyg"),
    (r"hush[åa]ll", "hem/husgerad-kok"),
    (r"kl[äa]der|\bmode\b", "klader/klader-skor"),
    (r"\bbygg\b|\bhem\b", "bygg/byggmaterial"),
    (r"fritid|elektronik", "elektronik/ljud-bild-tv"),
    (r"aff[äa]rs|butik|kontor", "restaurang/butik"),
)

# Words of an auction's title or contact that tell of an insolvency, each with the field it counts in.
INSOLVENCY_WORDS = (("title", "konkurs"), ("contact", "konkurs"), ("contact", "advokat"), ("title", "likvidation"))

# Patterns of what titles and descriptions state: a number of pieces, a pair, a plate, a thing never used, a brand.
LOT_COUNT = r"(?i)(\d+)\s*(?:stycken|styck|st)\.?\b"
LOT_PAIR = r"(?i)\bett\s+par\b|\b1\s+par\b|,\s*par\b|\bpar,|\bpar\s+(?=[”\"“])"
PLATE = r"\b([A-HJ-PR-UW-Z]{3})\s?(\d{2}[\dA-HJ-PR-UW-Z])\b"
NEW_THING = r"\b(ny|nytt|nya|oanvänd|oanvänt|unused|new\s+condition)\b"
BRAND = r"(?iu)(?:Märke|Fabrikat|Tillverkare)\s*[:=]\s*([^\n,]+)"

# Character references that sources use, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}

# Labels of a table that stand for months.
MONTH_LABEL = r"(?iu)^(januari|februari|mars|april|maj|juni|juli|augusti|september|oktober|november|december|jan|feb|mar|apr|jun|jul|aug|sep|okt|nov|dec)\b|^\d{4}-\d{2}"

# Where the fields of a card stand on the pages of two sources, and of a lot's table of facts.
METROPOL_CARD = {
    "start": "block-product-cards__card",
    "link": r'href="(/go/\d+/(\d+))"',
    "title": r"(?i)__name[^>]*>\s*([^<]+)",
    "description": r"(?is)__description[^>]*>(.*?)</p>",
    "least": r"(?i)Bjud mer än:\s*<span>([^<]+)</span>",
    "end": r'(?i)<time datetime="([^"]+)"',
    "image": r'(?i)<img\s+src="([^"]+\.(?:jpe?g|png|webp))"',
}
PANTBANKEN_CARD = {
    "start": r'(?=<div class="varubild">)',
    "key": r"f_id=(\d+)",
    "title": r'(?is)<h5><a class="vara"[^>]*>(.*?)</a>',
    "alt": r'(?i)alt="([^"]+)"',
    "bid": r'(?i)aktuellt_bud current-bid">([^<]+)',
    "start_bid": r'(?i)name="start_bud"[^>]*value="(\d+)"',
    "leader": r'(?i)bid-leader">([^<]*)',
    "bids": r'(?i)num-bids">([^<]*)',
    "end": r'(?i)class="stanger">([^<]+)',
    "image": r'(?i)<img\s+src="([^"]*imagehandler[^"]+)"',
}
LOT_FACT = r'(?i)class="varurubrik">([^<]+)</td>\s*<td class="varuvarde">([^<]*)<'
NO_FACT = "(?i)utropspris|aktuellt bud|stänger|provision"

# Labels of a vehicle's page, and where a price stands behind a heading.
VEHICLE = {
    "status": "Status", "registered": "Först registrerad", "owners": "Antal ägare", "inspected": "Senast besiktigad", "odometer": "Mätarställning (besiktning)", "tax": "Årlig skatt",
    "on_credit": "Kreditköp", "imported": "Import / Införsel", "horsepower": "Hästkrafter", "fuel": "Drivmedel", "other_fuel": "Bränsle",
}
PRICE_RANGE = r"(?is)<h4>{label}:?</h4>.{{0,300}}?<em>([^<]+)</em>"

# Bounds of the price bands that a search over its ceiling is first divided into.
PRICE_BANDS = (0, 100, 200, 300, 500, 1000, 2500, 10000, 100000, 5000000)

# Where facts stand on the list pages and lot pages of two houses.
LOT_PAGES = {
    "link": "(?=/auktion/objekt/([a-z0-9åäö-]+)(/))",  # the lot's id follows
    "end": "timeWrapper",
    "bid": "itemCurrentBid",
    "terms": "priceInfo",
    "fees": ("data-purchase-fee", "data-auction-fee", "data-item-vat"),
    "description": "itemDescription",
    "pictures": "AuctionItem",
    "small print": "cookie|villkor|provision|slagavgift|inloggad|samtycke",
    "worth": r"(?:Värdering|Utrop)[^0-9]{0,12}([\d\s]+)\s*kr",
    "house": r"\s*-\s*Sik[öo] Auktioner$",
    "picture": "https://siko-im920.fra1.cdn.digitaloceanspaces.com/{lot:08}_{n}.jpg",
}

# Where facts stand on the list pages and lot pages of six more houses (class names, links, labels).
HOUSE_PAGES = {
    "netauktion": {
        "origin": "https://www.netauktion.se", "card": "category-object-list", "link": r"/auktion/([a-z0-9-]+)\?product=\d+", "title": "object-card-title-text", "fact": "object-card-item-text", "place": "Lagringsort:", "end": "Avslutas:",
        "picture": r"/uploads/", "thumbnail": r"-m(?=\.(?:jpe?g|png)$)", "large": "-l", "description": ("object-description", "auction-description", "product-description"), "gallery": "my-simple-gallery-",
        "bid": r"([\d\s]+)\s*SEK", "auto": "autobud", "undivided": r"Starttid:\s*[\d:]+(.{20,1200}?)(?:Liknande|Andra objekt|Slagavgift|Frakt|Dela|$)",
    },
    "fabeo": {
        "price": "Price-amount", "end": "auction-time-countdown", "start": r"Startbud:\s*([\d\s]+)", "step": r"Höjning per bud:\s*([\d\s]+)", "fee": r"slagavgift\s+p\D*([\d\s]+)\s*kr", "exempt": "momsfri|momsbefria|ingen moms", "vat": r"(\d+)\s*%\s*moms\s+tillkommer",
        "no reserve": "Inget reservationspris", "met": "reservation_yes", "not met": "reservation_no", "said not met": r"Reservationspris\s+ej\s+uppn", "said met": r"Reservationspris\s+uppn", "count": r"Bud\s*\((\d+)\)", "bid row": r"logid-(\d+)",
    },
    "budi": {
        "origin": "https://www.budi.se", "lot": "data-budi-auctionobject-", "title": "budi-auctionobject__desc", "amount": "bid-current-amount", "count": "bid-count notranslate", "fee": "data-budi-servicefee-", "picture": r"auctionobjects/images/[^\"'\s?)]+\.(?:jpe?g|png|webp)",
        "gallery": r"auctionobjects/images/([^/]+/\d+)(?:-\d+)?\.\w+$", "place": r"-(\d+)\.\w+$", "large": "https://media.budi.se/cdn-cgi/image/format=auto,quality=high,width=800/",
    },
    "bukowskis": {"link": r"/(?:sv|en)/(?:auctions/([^/]+)/)?lots/\d+-", "bid": r"Aktuellt bud\s+([\d\s]+?)\s+([A-Z]{3})", "estimate": r"Utropspris\s+([\d\s]+?)\s+([A-Z]{3})", "none": "Inga bud", "picture": r"https://[a-z0-9]+\.cloudfront\.net/[^\"\\\s&]+", "description": "lot-description"},
    "bna": {
        "event": r"/auktion/(\d{4}-\d{2}-\d{2}.*)/(\d+)", "lot": r"/auktion/objekt/.+/(\d+)", "bid": r"Högsta bud\D{0,8}([\d\s]+?)\s*kr", "least": r"Utrop(?:spris)?\D{0,8}([\d\s]+?)\s*kr", "end": r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?",
        "vat": "Moms tillkommer med 25", "place": r"(?:Ort|Plats|Avhämtning)\s*:?\s*([A-ZÅÄÖ][A-Za-zÅÄÖåäö -]{2,30})", "picture": r"/images/custom/AuctionItem/(?:[a-z]+/)?(\d+)\.jpg", "full": "https://bna.nu/images/custom/AuctionItem/{}.jpg",
    },
    "blinto": {
        "link": r"/auction/[A-Za-z0-9-]+-(\d+)-(\d+)/", "kind": "brand-type", "title": "h3-second-line", "place": "card-location", "end": "time-left_", "date": r"\d{1,2}\s+(?:jan|feb|mar|apr|maj|jun|jul|aug|sep|okt|nov|dec)\s+\d{1,2}:\d{2}", "bid": r"([\d\s]{2,})\s*SEK", "bids": r"(\d+)\s*bud",
        "picture": r"https://(?:cdn|static)\.blinto\.se/object/[^\"\s]+?\.(?:jpe?g|webp|png)", "cdn": "cdn.blinto.se", "large": "/1200x900f", "fee": r"slagavgift\s+p\S*\s+([\d\s]+?)\s*(?:SEK|kr)\s*\(exkl", "exempt": r"Momsfri\s+f\S*ljning(?!\s*\":)", "vat": r"25\s*%\s*moms tillkommer p\S* lagt bud(?!\s*\":)",
        "description": "description-content", "house text": r"Blintos\s+auktionsm\S*klare|Objektet\s+s\S*ljs\s+p\S*\s+uppdrag|Har\s+du\s+ocks\S*\s+n\S*got\s+att\s+s\S*lja",
    },
    "kronofogden": {
        "card": "obj_thumbnail", "link": r"w\.object\?inC=KFM&inA=([0-9_]+)&inO=(\d+)", "facts": "obj_txt", "number": "text-muted", "place": "glyphicon-map-marker", "bid": "bid_txt_", "amount": r"(\d[\d\s]*?)\s*SEK", "start": "startpris", "clock": "time_txt_",
        "picture": r"https://[a-z0-9.]*auction2000[^\"'\s]*/{id}_\d+[^\"'\s]*?\.(?:jpe?g|png)", "size": r"_(?:thumb|mid|small)(?=\.(?:jpe?g|png))", "description": "margin-top:20px",
        "house text": "Vi (?:kan inte erbjuda frakt|erbjuder frakt|säljer all egendom)|Objektet har ing[åa]tt i momspliktig",
    },
}

# Addresses of two sources' pictures, and where a page holds its data.
FRIVIO_PICTURE = "https://backend.frivio.se/vehicle/"
BIDFLOW_PICTURE = ("https://img.imageboss.me/", "byraneffecta", "/width/1600/withoutEnlargement:true/")
PAGE_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'

# Units of a countdown and their seconds.
COUNTDOWN = ((r"(\d+)\s*(?:dygn|dagar|dag|d\b)", 86400), (r"(\d+)\s*(?:timmar|timme|tim|h\b)", 3600), (r"(\d+)\s*(?:minuter|minut|min|m\b)", 60), (r"(\d+)\s*(?:sekunder|sekund|sek|s\b)", 1))
