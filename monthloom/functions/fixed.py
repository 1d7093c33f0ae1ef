"""Names, labels and tables that results depend on."""

# The weather vector, in display order.
WEATHER_COLUMNS = (
    "temperature_moyenne",
    "temperature_max",
    "temperature_min",
    "precipitation",
    "humidite",
    "vent",
    "rayonnement_solaire",
)

# Display label of each weather column.
WEATHER_LABELS = {
    "temperature_moyenne": "Température moyenne (°C)",
    "temperature_max": "Température max (°C)",
    "temperature_min": "Température min (°C)",
    "precipitation": "Précipitations (mm/j)",
    "humidite": "Humidité (%)",
    "vent": "Vent (m/s)",
    "rayonnement_solaire": "Rayonnement solaire (kWh/m²)",
}

# Display label of the target.
TARGET_LABEL = "Cas confirmés (TDR)"

# French month names, January first.
MONTHS_FR = (
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
)

# English month names, January first.
MONTHS_EN = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)

# French short month labels, January first.
MONTHS_SHORT_FR = (
    "Jan", "Fév", "Mar", "Avr", "Mai", "Juin",
    "Juil", "Août", "Sep", "Oct", "Nov", "Déc",
)

# Relative scenarios
# (name, rain %, temperature delta, humidity points, wind %, sun %).
RELATIVE_SCENARIOS = (
    ("Personnalisé", 0.0, 0.0, 0.0, 0.0, 0.0),
    ("Hivernage abondant (+30 % pluie, +5 pts humidité)", 30.0, 0.0, 5.0, 0.0, 0.0),
    ("Sécheresse (−30 % pluie, −5 pts humidité, +1 °C)", -30.0, 1.0, -5.0, 0.0, 0.0),
    ("Réchauffement (+2 °C)", 0.0, 2.0, 0.0, 0.0, 0.0),
    ("Refroidissement (−1 °C, +10 % pluie)", 10.0, -1.0, 0.0, 0.0, 0.0),
)
BASE_SCENARIO = "Base (climatologie)"

# Absolute scenarios
# (name, temperature, rain, humidity, wind, sun).
ABSOLUTE_SCENARIOS = (
    ("normal", 25.0, 50.0, 70.0, 20.0, 40.0),
    ("hot_dry", 35.0, 0.0, 30.0, 15.0, 70.0),
    ("rainy", 28.0, 200.0, 90.0, 25.0, 20.0),
)

# Feature family labels.
FAMILY_KEY = "Région (one-hot)"
FAMILY_HISTORY = "Historique des cas (lags / moyennes glissantes)"
FAMILY_WEATHER = "Météo"
FAMILY_CALENDAR = "Calendrier"
KEY_LABEL_PREFIX = "Région : "

# Thousands separator and the mark for an unusable number.
THIN_SPACE = "\u202f"
NO_VALUE = "—"
