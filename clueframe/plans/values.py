"""Tables that must hold exactly these entries for results to be right.

Nothing here is derived; codes are ISO country codes.  Adjacency is not held here: it
is an input table of directed edges (src, dst).
"""

# ---- fixed values: evidence weights by country ----

RED_SOIL = {
    "AU": 20, "BR": 20, "NG": 18, "ZA": 18, "BW": 18, "KE": 16, "UG": 16, "GH": 16, "SN": 14, "MG": 16, "US": 16, "KH": 14, "LK": 10,
    "UY": 8, "AR": 8, "ES": 16, "PT": 14, "IT": 14, "GR": 14, "TR": 14, "IN": 16, "BD": 14, "CO": 10, "PY": 12, "BO": 12,
}
YELLOW_LINES = {
    "US": 18, "CA": 16, "MX": 14, "BR": 12, "CO": 12, "AR": 12, "CL": 12, "PE": 10, "ZA": 14, "BW": 14, "SZ": 14, "LS": 14, "NA": 14,
    "JP": 10, "PH": 8, "TH": 10, "MY": 8, "TW": 8, "NO": 10, "FI": 10, "IS": 10, "IL": 10,
}
WHITE_LINES_EUROPE = (
    "UA PL DE FR ES IT RO CZ SK AT CH HU BG LT LV EE GR TR PT HR SI RS MK AL ME NL BE DK SE NO FI IE GB LU IS"
).split()
ARID = {
    "JO": 15, "AE": 15, "QA": 15, "OM": 15, "EG": 14, "TN": 12, "BW": 14, "NA": 14, "ZA": 12, "AU": 16, "US": 16, "CL": 12, "PE": 12,
    "AR": 10, "MX": 10, "ES": 10, "TR": 10, "GR": 8, "MN": 12, "IL": 12,
}
TROPICAL_LUSH = {
    "BD": 24, "IN": 22, "LK": 22, "TH": 20, "MY": 20, "ID": 20, "PH": 20, "VN": 20, "CR": 20, "CO": 22, "BR": 18, "EC": 18, "NG": 16,
    "GH": 16, "TW": 16,
}
LUSH = {
    "GB": 16, "IE": 16, "CZ": 16, "SK": 16, "PL": 16, "AT": 16, "DE": 16, "FR": 16, "HU": 14, "CH": 14, "US": 12, "CA": 10, "JP": 12,
    "NZ": 12, "AU": 10, "CR": 12, "BR": 14, "ID": 14, "MY": 14, "PH": 12, "TH": 14, "EC": 14, "CO": 16, "UA": 10, "VN": 12, "TW": 12,
    "BD": 12, "IN": 12, "LK": 12, "ES": 16, "PT": 14, "IT": 16, "GR": 14, "TR": 14,
}
UNPAVED = {
    "BR": 18, "MN": 15, "BW": 14, "MG": 14, "KG": 14, "BO": 14, "PE": 12, "LA": 12, "SN": 12, "KH": 12, "ZA": 10, "NG": 16, "UG": 15,
    "GH": 14, "CO": 14, "PY": 14, "AR": 12,
}

# ---- fixed values: sets of countries ----

SOUTHERN = "AU NZ ZA BW SZ LS NA AR CL UY PY BO PE MG ID BR EC KE UG RW TZ".split()
NORTHERN = (
    "US CA MX GB IE FR ES PT DE IT NL BE DK NO SE FI EE LV LT PL CZ SK AT CH HU RO BG GR TR UA RU KZ MN JP KR TW TH VN PH MY IN BD LK "
    "IL JO AE QA OM AD IS SI HR RS MK AL ME"
).split()
EQUATORIAL = "EC CO BR ID MY SG KE UG GH SN NG LK TH VN PH MX IN PA CR GT KH LA".split()
HIGH_NORTH = "NO SE FI IS EE LV LT RU CA GB IE DK NL BE DE PL CZ SK AT CH HU UA RO BG KZ MN".split()
TEMPERATE = "DE FR PL UA GB CZ SK AT CH US CA NZ JP CL AR RO HU IT ES GR TR HR SI SE NO FI IE NL BE DK EE LV LT BG RS MK".split()
LEFT_TRAFFIC = (
    "GB IE MT CY IM JE GG JP ID MY TH SG HK MO IN PK BD LK NP BT BN TL ZA BW SZ LS NA KE UG TZ ZW ZM MZ MW MU SC AU NZ PG FJ WS TO SB "
    "GY SR JM BS BB TT VI"
).split()
LEFT_TRAFFIC_GUIDE = "GB IE AU NZ ZA BW SZ LS KE UG JP MY SG TH ID LK BD BT IN HK MO MT CY BM VI CX CC IM JE".split()
CONTINENTS = {
    "north america": "US CA MX".split(),
    "south america": "BR AR CL CO PE EC UY BO PY".split(),
    "europe": "UA PL DE FR ES IT RO CZ SK AT HU BG LT LV EE GB IE NL BE DK NO SE FI CH PT GR SI HR RS MK AL ME AD".split(),
    "africa": "ZA KE UG GH SN BW NG NA SZ LS EG TN".split(),
    "asia": "JP KR TW TH VN ID MY PH IN BD LK SG KH LA".split(),
    "oceania": "AU NZ".split(),
}
PROFILE_SETS = {
    "tropical": "ID MY PH TH VN KH LA SG CO CR PA EC BR LK".split(),
    "boreal": "RU CA FI SE NO EE LV LT".split(),
    "savanna": "KE BW ZA NA SN TZ UG ZM ZW GH NG".split(),
    "yellow_center": "US CA MX BR CO EC PE CL ID MY TH TW JP NO FI IS".split(),
    "white_only": "RU UA BY PL DE FR IT ES PT GB AU AT CZ SK HU RO BG GR TR EE LV LT DK SE BE NL CH NZ".split(),
    "red_soil": "AU BR KE UG KH MG LS BW SZ ZA LK ID".split(),
    "unpaved": "ID MN KH UG KE BW MG LA BO PE SN".split(),
    "flat": "NL DK BE EE LV LT PL HU".split(),
}
CLUSTERS = {
    "southern_africa": "ZA BW SZ LS NA",
    "east_africa": "KE UG RW TZ",
    "west_africa": "SN GH NG",
    "southern_cone": "AR CL UY PY BR",
    "andean": "PE BO EC CO CL",
    "north_america": "US CA MX",
    "central_america": "GT CR PA MX",
    "middle_east": "AE QA OM SA KW BH JO IL LB",
    "arabian_peninsula": "AE QA OM SA KW BH YE",
    "nordic": "SE NO FI DK IS",
    "baltic": "EE LV LT",
    "baltic_sea": "EE LV LT PL SE FI DE RU",
    "northern_europe": "SE NO FI DK IS EE LV LT GB IE",
    "western_europe": "FR DE BE NL LU CH AT GB IE",
    "mediterranean": "ES PT IT GR TR HR SI AL MK ME CY MT",
    "eastern_europe": "PL CZ SK HU RO BG UA RU",
    "central_europe": "CZ SK PL AT HU DE SI CH RO UA",
    "post_soviet": "RU UA BY KZ KG MN",
    "eurasian_steppe": "MN KZ KG RU",
    "southeast_asia": "TH MY ID PH KH LA VN SG",
    "east_asia": "JP KR TW",
    "south_asia": "IN BD LK BT",
    "oceania": "AU NZ",
}

# ---- fixed values: latitude and longitude of each country's centre, and how likely it is to be seen ----

CENTERS = {
    "US": (37.0902, -95.7129), "CA": (56.1304, -106.3468), "MX": (23.6345, -102.5528), "BR": (-14.2350, -51.9253),
    "AR": (-38.4161, -63.6167), "CL": (-35.6751, -71.5430), "CO": (4.5709, -74.2973), "PE": (-9.1900, -75.0152),
    "EC": (-1.8312, -78.1834), "UY": (-32.5228, -55.7658), "BO": (-16.2902, -63.5887), "PY": (-23.4425, -58.4438),
    "GB": (55.3781, -3.4360), "IE": (53.1424, -7.6921), "FR": (46.2276, 2.2137), "ES": (40.4637, -3.7492),
    "PT": (39.3999, -8.2245), "DE": (51.1657, 10.4515), "IT": (41.8719, 12.5674), "NL": (52.1326, 5.2913),
    "BE": (50.5039, 4.4699), "CH": (46.8182, 8.2275), "AT": (47.5162, 14.5501), "PL": (51.9194, 19.1451),
    "CZ": (49.8175, 15.4730), "SK": (48.6690, 19.6990), "HU": (47.1625, 19.5033), "RO": (45.9432, 24.9668),
    "BG": (42.7339, 25.4858), "GR": (39.0742, 21.8243), "UA": (48.3794, 31.1656), "RU": (61.5240, 105.3188),
    "TR": (38.9637, 35.2433), "DK": (56.2639, 9.5018), "SE": (60.1282, 18.6435), "NO": (60.4720, 8.4689),
    "FI": (61.9241, 25.7482), "EE": (58.5953, 25.0136), "LV": (56.8796, 24.6032), "LT": (55.1694, 23.8813),
    "IS": (64.9631, -19.0208), "SI": (46.1512, 14.9955), "HR": (45.1000, 15.2000), "RS": (44.0165, 21.0059),
    "MK": (41.6086, 21.7453), "AL": (41.1533, 20.1683), "ME": (42.7087, 19.3744), "AD": (42.5063, 1.5218),
    "ZA": (-30.5595, 22.9375), "BW": (-22.3285, 24.6849), "SZ": (-26.5225, 31.4659), "LS": (-29.6099, 28.2336),
    "NA": (-22.9576, 18.4904), "KE": (-0.0236, 37.9062), "UG": (1.3733, 32.2903), "GH": (7.9465, -1.0232),
    "SN": (14.4974, -14.4524), "NG": (9.0820, 8.6753), "EG": (26.8206, 30.8025), "TN": (33.8869, 9.5375),
    "JP": (36.2048, 138.2529), "KR": (35.9078, 127.7669), "TW": (23.6978, 120.9605), "TH": (15.8700, 100.9925),
    "VN": (14.0583, 108.2772), "MY": (4.2105, 101.9758), "ID": (-0.7893, 113.9213), "PH": (12.8797, 121.7740),
    "SG": (1.3521, 103.8198), "KH": (12.5657, 104.9910), "LA": (19.8563, 102.4955), "IN": (20.5937, 78.9629),
    "BD": (23.6850, 90.3563), "LK": (7.8731, 80.7718), "BT": (27.5142, 90.4336), "MN": (46.8625, 103.8467),
    "KG": (41.2044, 74.7661), "JO": (30.5852, 36.2384), "IL": (31.0461, 34.8516), "AE": (23.4241, 53.8478),
    "QA": (25.3548, 51.1839), "OM": (21.4735, 55.9754), "SA": (23.8859, 45.0792), "KW": (29.3117, 47.4818),
    "AU": (-25.2744, 133.7751), "NZ": (-40.9006, 174.8860), "CR": (9.7489, -83.7534), "GT": (15.7835, -90.2308),
    "PA": (8.5380, -80.7821), "DO": (18.7357, -70.1627), "PR": (18.2208, -66.5901), "CW": (12.1696, -68.9900),
    "MG": (-18.7669, 46.8691), "RW": (-1.9403, 29.8739), "TZ": (-6.3690, 34.8888), "LU": (49.8153, 6.1296),
    "MT": (35.9375, 14.3754), "CY": (35.1264, 33.4299), "HK": (22.3193, 114.1694), "MO": (22.1987, 113.5439),
    "GU": (13.4443, 144.7937),
}
PRIOR_DEFAULT = 0.2
PRIORS = {
    "US": 0.9, "CA": 0.8, "BR": 0.8, "AU": 0.75, "JP": 0.75, "DE": 0.75, "FR": 0.65, "GB": 0.65, "ES": 0.7, "IT": 0.7, "MX": 0.7,
    "ID": 0.65, "TH": 0.6, "ZA": 0.6, "PL": 0.70, "UA": 0.55, "AR": 0.55, "CL": 0.55, "CO": 0.55, "TR": 0.55, "SE": 0.5, "NO": 0.5,
    "FI": 0.5, "NZ": 0.5, "MY": 0.5, "PH": 0.5, "RO": 0.5, "CZ": 0.70, "SK": 0.65, "AT": 0.65, "HU": 0.55, "NL": 0.5, "BE": 0.5,
    "DK": 0.5, "PT": 0.5, "GR": 0.45, "IE": 0.45, "PE": 0.4, "EC": 0.4, "KE": 0.35, "UG": 0.35, "GH": 0.35, "SN": 0.35, "NG": 0.35,
    "BW": 0.35, "LK": 0.35, "BD": 0.35, "TW": 0.35, "KR": 0.35, "UY": 0.3, "BO": 0.3, "PY": 0.3, "BG": 0.35, "HR": 0.35, "RS": 0.3,
    "SI": 0.35, "EE": 0.35, "LV": 0.35, "LT": 0.35, "IS": 0.3, "CH": 0.3, "MN": 0.25, "KG": 0.25, "CR": 0.25, "GT": 0.25, "PA": 0.25,
    "JO": 0.2, "AE": 0.2, "QA": 0.2, "OM": 0.2, "TN": 0.2, "SZ": 0.2, "LS": 0.2, "NA": 0.2, "MK": 0.2, "AL": 0.2, "ME": 0.2,
    "AD": 0.15, "SM": 0.15, "MC": 0.15, "LI": 0.15, "LU": 0.15, "MT": 0.15, "CY": 0.15, "FO": 0.1, "GL": 0.1, "BM": 0.1, "CW": 0.1,
    "GU": 0.1, "MP": 0.1,
}

# ---- fixed values: words ----

DEMONYMS = {
    "IE": "ireland|irish", "VN": "vietnam|vietnamese", "ES": "spain|spanish", "AD": "andorra|andorran",
    "BR": "brazil|brazilian|portuguese", "CA": "canada|canadian|quebec", "MX": "mexico|mexican",
    "US": "united states|american|usa|cascadia", "JP": "japan|japanese|hokkaido", "SE": "sweden|swedish", "NO": "norway|norwegian",
    "DK": "denmark|danish", "FI": "finland|finnish", "DE": "germany|german", "FR": "france|french", "IT": "italy|italian",
    "PL": "poland|polish", "UA": "ukraine|ukrainian", "RU": "russia|russian", "KZ": "kazakhstan|kazakh", "CO": "colombia|colombian",
    "EC": "ecuador|ecuadorian|esmeraldas", "PE": "peru|peruvian", "CL": "chile|chilean|atacama",
    "AR": "argentina|argentine|argentinean", "ZA": "south africa|south african|afrikaans", "KE": "kenya|kenyan",
    "ID": "indonesia|indonesian|java|sumatra|bali", "MY": "malaysia|malaysian", "TH": "thailand|thai",
    "PH": "philippines|filipino|philippine", "AU": "australia|australian|eucalyptus", "NZ": "new zealand|kiwi|waikato",
    "GR": "greece|greek", "TR": "turkey|turkish", "RO": "romania|romanian", "BG": "bulgaria|bulgarian", "EE": "estonia|estonian",
    "LV": "latvia|latvian", "LT": "lithuania|lithuanian", "MK": "north macedonia|macedonian|macedonia", "SK": "slovakia|slovak",
    "CZ": "czech|czechia", "HU": "hungary|hungarian", "NL": "netherlands|dutch", "BE": "belgium|belgian", "CH": "switzerland|swiss",
    "AT": "austria|austrian", "PT": "portugal|portuguese", "BD": "bangladesh|bengali|bangla", "LK": "sri lanka|sinhala|sri lankan",
    "IN": "india|indian|hindi", "TW": "taiwan|taiwanese", "KR": "south korea|korean", "AE": "uae|emirates|emirati|arabic",
    "SI": "slovenia|slovenian",
}
GENERIC_SIGNALS = (
    "red soil", "yellow road lines", "white road lines", "concrete road pavement", "concrete pavement",
    "dominant white road markings with yellow curb lines", "arid dry desert landscape", "lush green vegetation",
    "temperate vegetation", "unpaved dirt road", "open fields / grassland", "low sun angle / temperate or subpolar latitude",
    "high sun angle / tropical latitude", "red google car",
)
GENERIC_TITLES = (
    "architecture", "country flag", "licence plates", "chevrons", "kilometre markers", "bollards", "directional signs", "road lines",
    "red soil", "phone area codes", "pedestrian crossing signs", "utility poles", "chevron signs", "language", "bus stop signs",
    "topography", "telephone area codes", "stop signs", "striped signposts", "corn fields", "trident pole tops", "direction signs",
    "tea plantations", "area codes", "grey ev camera car", "vegetation", "nature", "soil", "houses", "landscape", "roads", "trees",
    "sun", "sky", "fields",
)
STOP_WORDS = (
    "country state road border which there where angle latitude temperate subpolar tropical fields grassland vegetation landscape "
    "coverage street google lines white yellow asphalt unpaved paved driving right left found using common across along places often rural"
).split()
UNTELLING_CLUES = (
    "vehicles drive on the right", "vehicles drive on the left", "traffic here appears to drive on the right side of the road",
    "drives on right", "drives on left", "sun to north", "sun to south",
)
CONTINENT_QUALIFIERS = "influenced style architecture settler heritage type".split()
