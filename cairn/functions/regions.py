"""Regions: their countries, capitals, which stars are raised, and which parts of a country stay.

All values here are fixed values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CAPITALS = {
    "south_america": {
        "Argentina": ("Buenos Aires", -58.3816, -34.6037), "Bolivia": ("La Paz", -68.1193, -16.4897), "Brazil": ("Brasilia", -47.8825, -15.7942), "Chile": ("Santiago", -70.6693, -33.4489),
        "Colombia": ("Bogotá", -74.0721, 4.7110), "Ecuador": ("Quito", -78.4678, -0.1807), "Guyana": ("Georgetown", -58.1553, 6.8013), "Paraguay": ("Asunción", -57.5759, -25.2637),
        "Peru": ("Lima", -77.0428, -12.0464), "Suriname": ("Paramaribo", -55.2038, 5.8520), "Uruguay": ("Montevideo", -56.1645, -34.9011), "Venezuela": ("Caracas", -66.9036, 10.4806), "French Guiana": ("Cayenne", -52.3350, 4.9220),
    },
    "africa": {
        "Algeria": ("Algiers", 3.0588, 36.7538), "Angola": ("Luanda", 13.2344, -8.8383), "Benin": ("Porto-Novo", 2.6297, 6.4969), "Botswana": ("Gaborone", 25.9231, -24.6282), "Burkina Faso": ("Ouagadougou", -1.5247, 12.3714),
        "Burundi": ("Gitega", 29.9306, -3.4271), "Cameroon": ("Yaoundé", 11.5174, 3.8480), "Central African Republic": ("Bangui", 18.5550, 4.3947), "Chad": ("N'Djamena", 15.0444, 12.1348), "Congo": ("Brazzaville", 15.2663, -4.2634),
        "Republic of the Congo": ("Brazzaville", 15.2663, -4.2634), "Democratic Republic of the Congo": ("Kinshasa", 15.3222, -4.3369), "Djibouti": ("Djibouti", 43.1456, 11.5720), "Egypt": ("Cairo", 31.2357, 30.0444),
        "Equatorial Guinea": ("Malabo", 8.7832, 3.7504), "Eritrea": ("Asmara", 38.9318, 15.3229), "eSwatini": ("Mbabane", 31.1367, -26.3054), "Ethiopia": ("Addis Ababa", 38.7469, 9.0320), "Gabon": ("Libreville", 9.4535, 0.4162),
        "Gambia": ("Banjul", -16.5917, 13.4549), "Ghana": ("Accra", -0.1870, 5.6037), "Guinea": ("Conakry", -13.7000, 9.6412), "Guinea-Bissau": ("Bissau", -15.5989, 11.8636), "Ivory Coast": ("Yamoussoukro", -5.2767, 6.8270),
        "Kenya": ("Nairobi", 36.8219, -1.2864), "Lesotho": ("Maseru", 27.4833, -29.3167), "Liberia": ("Monrovia", -10.8047, 6.3156), "Libya": ("Tripoli", 13.1913, 32.8872), "Madagascar": ("Antananarivo", 47.5079, -18.8792),
        "Malawi": ("Lilongwe", 33.7838, -13.9626), "Mali": ("Bamako", -8.0029, 12.6392), "Mauritania": ("Nouakchott", -15.9785, 18.0735), "Morocco": ("Rabat", -6.8498, 33.9716), "Mozambique": ("Maputo", 32.5732, -25.9655),
        "Namibia": ("Windhoek", 17.0832, -22.5597), "Niger": ("Niamey", 2.1154, 13.5127), "Nigeria": ("Abuja", 7.5400, 9.0579), "Rwanda": ("Kigali", 30.0619, -1.9536), "Senegal": ("Dakar", -17.4677, 14.7167),
        "Sierra Leone": ("Freetown", -13.2317, 8.4657), "Somalia": ("Mogadishu", 45.3438, 2.0469), "South Africa": ("Pretoria", 28.1881, -25.7479), "South Sudan": ("Juba", 31.5825, 4.8594), "Sudan": ("Khartoum", 32.5599, 15.5007),
        "Tanzania": ("Dodoma", 35.7382, -6.1630), "United Republic of Tanzania": ("Dodoma", 35.7382, -6.1630), "Togo": ("Lomé", 1.2255, 6.1256), "Tunisia": ("Tunis", 10.1658, 36.8065), "Uganda": ("Kampala", 32.5825, 0.3476),
        "Zambia": ("Lusaka", 28.2871, -15.3875), "Zimbabwe": ("Harare", 31.0539, -17.8252),
    },
    "middle_east": {
        "Georgia": ("Tbilisi", 44.7833, 41.7151), "Armenia": ("Yerevan", 44.5152, 40.1872), "Azerbaijan": ("Baku", 49.8822, 40.4093), "Egypt": ("Cairo", 31.2357, 30.0444), "Israel": ("Jerusalem", 35.2137, 31.7683),
        "Palestine": ("Ramallah", 35.2063, 31.9038), "Jordan": ("Amman", 35.9450, 31.9539), "Lebanon": ("Beirut", 35.5093, 33.8886), "Syria": ("Damascus", 36.2765, 33.5138), "Saudi Arabia": ("Riyadh", 46.7219, 24.7136),
        "Yemen": ("Sana'a", 44.2075, 15.3694), "Oman": ("Muscat", 58.4059, 23.6100), "United Arab Emirates": ("Abu Dhabi", 54.3773, 24.4539), "Qatar": ("Doha", 51.5310, 25.2854), "Bahrain": ("Manama", 50.5577, 26.2285),
        "Kuwait": ("Kuwait City", 47.9774, 29.3759), "Iraq": ("Baghdad", 44.3661, 33.3152), "Iran": ("Tehran", 51.4231, 35.6892), "Turkey": ("Ankara", 32.8597, 39.9334), "Cyprus": ("Nicosia", 33.3823, 35.1856),
    },
    "caucasus_central_asia": {
        "Georgia": ("Tbilisi", 44.7833, 41.7151), "Armenia": ("Yerevan", 44.5152, 40.1872), "Azerbaijan": ("Baku", 49.8822, 40.4093), "Kazakhstan": ("Astana", 71.4704, 51.1694), "Uzbekistan": ("Tashkent", 69.2401, 41.2995),
        "Turkmenistan": ("Ashgabat", 58.3261, 37.9509), "Tajikistan": ("Dushanbe", 68.7870, 38.5598), "Kyrgyzstan": ("Bishkek", 74.5698, 42.8746), "Afghanistan": ("Kabul", 69.2075, 34.5553),
    },
    "europe": {
        "France": ("Paris", 2.3522, 48.8566), "Germany": ("Berlin", 13.4050, 52.5200), "United Kingdom": ("London", -0.1276, 51.5074), "Ireland": ("Dublin", -6.2603, 53.3498), "Belgium": ("Brussels", 4.3517, 50.8503),
        "Netherlands": ("Amsterdam", 4.8952, 52.3702), "Luxembourg": ("Luxembourg", 6.1296, 49.6116), "Switzerland": ("Bern", 7.4474, 46.9480), "Austria": ("Vienna", 16.3738, 48.2082), "Spain": ("Madrid", -3.7038, 40.4168),
        "Portugal": ("Lisbon", -9.1393, 38.7223), "Italy": ("Rome", 12.4964, 41.9028), "Greece": ("Athens", 23.7275, 37.9838), "Malta": ("Valletta", 14.5146, 35.8989), "Albania": ("Tirana", 19.8187, 41.3275),
        "North Macedonia": ("Skopje", 21.4254, 41.9973), "Montenegro": ("Podgorica", 19.2636, 42.4304), "Bosnia and Herzegovina": ("Sarajevo", 18.4131, 43.8564), "Serbia": ("Belgrade", 20.4489, 44.7866),
        "Croatia": ("Zagreb", 15.9819, 45.8150), "Slovenia": ("Ljubljana", 14.5058, 46.0569), "Norway": ("Oslo", 10.7522, 59.9139), "Sweden": ("Stockholm", 18.0686, 59.3293), "Finland": ("Helsinki", 24.9384, 60.1695),
        "Denmark": ("Copenhagen", 12.5683, 55.6761), "Iceland": ("Reykjavik", -21.8174, 64.1466), "Estonia": ("Tallinn", 24.7536, 59.4370), "Latvia": ("Riga", 24.1052, 56.9496), "Lithuania": ("Vilnius", 25.2797, 54.6872),
        "Poland": ("Warsaw", 21.0122, 52.2297), "Czech Republic": ("Prague", 14.4378, 50.0755), "Slovakia": ("Bratislava", 17.1077, 48.1486), "Hungary": ("Budapest", 19.0402, 47.4979), "Romania": ("Bucharest", 26.1025, 44.4268),
        "Bulgaria": ("Sofia", 23.3219, 42.6977), "Moldova": ("Chisinau", 28.8497, 47.0105), "Ukraine": ("Kyiv", 30.5234, 50.4501), "Belarus": ("Minsk", 27.5615, 53.9045),
    },
    "north_central_america": {
        "Canada": ("Ottawa", -75.6972, 45.4215), "United States of America": ("Washington D.C.", -77.0369, 38.9072), "Mexico": ("Mexico City", -99.1332, 19.4326), "Belize": ("Belmopan", -88.4976, 17.2510),
        "Costa Rica": ("San José", -84.0907, 9.9281), "El Salvador": ("San Salvador", -89.2182, 13.6929), "Guatemala": ("Guatemala City", -90.5069, 14.6349), "Honduras": ("Tegucigalpa", -87.2068, 14.0723),
        "Nicaragua": ("Managua", -86.2362, 12.1150), "Panama": ("Panama City", -79.5188, 8.9824), "Cuba": ("Havana", -82.3666, 23.1136), "Jamaica": ("Kingston", -76.7936, 18.0179), "Haiti": ("Port-au-Prince", -72.3074, 18.5944),
        "Dominican Republic": ("Santo Domingo", -69.9312, 18.4861), "Bahamas": ("Nassau", -77.3963, 25.0343), "Trinidad and Tobago": ("Port of Spain", -61.5171, 10.6918),
    },
}
#: Countries of a region's run where they aren't all those with a capital; a null list means the whole continent.
COUNTRIES = {
    "south_america": None, "africa": None, "middle_east": ["Armenia", "Azerbaijan", "Georgia", "Egypt", "Israel", "Palestine", "Jordan", "Lebanon", "Syria", "Saudi Arabia", "Yemen", "Oman", "United Arab Emirates", "Qatar", "Bahrain", "Kuwait", "Iraq", "Iran"],
    "caucasus_central_asia": ["Georgia", "Armenia", "Azerbaijan", "Kazakhstan", "Uzbekistan", "Turkmenistan", "Tajikistan", "Kyrgyzstan", "Afghanistan"],
    "central_america": ["Belize", "Costa Rica", "El Salvador", "Guatemala", "Honduras", "Nicaragua", "Panama", "Mexico"],
    "north_central_america": ["Canada", "United States of America", "Mexico", "Belize", "Costa Rica", "El Salvador", "Guatemala", "Honduras", "Nicaragua", "Panama"],
    "europe": ["France", "Germany", "United Kingdom", "Ireland", "Belgium", "Netherlands", "Luxembourg", "Switzerland", "Austria", "Liechtenstein", "Monaco", "Andorra", "Spain", "Portugal", "Italy", "Greece", "Malta", "San Marino", "Vatican", "Albania", "North Macedonia", "Montenegro", "Bosnia and Herzegovina", "Serbia", "Kosovo", "Croatia", "Slovenia", "Norway", "Sweden", "Finland", "Denmark", "Iceland", "Estonia", "Latvia", "Lithuania", "Poland", "Czech Republic", "Slovakia", "Hungary", "Romania", "Bulgaria", "Moldova", "Ukraine", "Belarus"],
}
CONTINENT = {"south_america": "South America", "africa": "Africa"}
#: Where the star is raised, as it would cut through a coast or border.
RAISED = {
    "africa": ["Algeria", "Angola", "Benin", "Djibouti", "Equatorial Guinea", "Gabon", "Gambia", "Ghana", "Guinea", "Guinea-Bissau", "Liberia", "Libya", "Mauritania", "Morocco", "Mozambique", "Senegal", "Sierra Leone", "Somalia", "Togo", "Tunisia", "Republic of the Congo", "Democratic Republic of the Congo", "Chad"],
    "middle_east": ["Egypt", "Israel", "Lebanon", "Syria", "United Arab Emirates", "Qatar", "Bahrain", "Kuwait", "Oman", "Cyprus"],
    "caucasus_central_asia": ["Azerbaijan"], "central_america": ["Panama", "Belize"],
    "europe": ["United Kingdom", "Ireland", "Netherlands", "Belgium", "Portugal", "Spain", "Greece", "Malta", "Albania", "Montenegro", "Croatia", "Norway", "Sweden", "Finland", "Denmark", "Iceland", "Estonia", "Latvia", "Lithuania"],
}
#: Parts that stay: the largest so many (None: all), those east of a centroid, and whether holes are closed.
RULES = [("Azerbaijan", 2, 50.0, False), ("Kazakhstan", 1, None, True)]
TOP_PARTS = {"south_america": None, "central_america": None, "africa": 1, "middle_east": 1, "caucasus_central_asia": 1, "europe": 1, "north_central_america": 1}
#: French Guiana is what of France lies in this box.
CUT_OUT = {"French Guiana": ("France", (-54.7, 2.0, -51.5, 6.0))}


def capitals(spark: SparkSession, *regions: str) -> DataFrame:
    """country, city, lon, lat, priority of some regions (all if none is named); of one country the last region's."""
    from pyspark.sql import functions as F

    from cairn.operators.vector import upsert

    schema = "country string, city string, lon double, lat double"
    tables = [spark.createDataFrame([(k, *v) for k, v in CAPITALS[r].items()], schema) for r in regions or CAPITALS]
    return upsert(tables, "country").select("country", "city", "lon", "lat", F.col("priority"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "feature string, top int, east_of double, drop_holes boolean")
