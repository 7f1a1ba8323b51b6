"""Parameters of the rules. They must equal the policy's for right results."""

CREDIT = {
    "bands": (("Excellent", 750), ("Good", 700), ("Fair", 650), ("Poor", 550)),
    "risk_tier": {"Excellent": "low", "Good": "low", "Fair": "moderate", "Poor": "high", "Very Poor": "high", "New-to-Credit": "moderate"},
    "band_points": {"Excellent": 100.0, "Good": 82.0, "Fair": 62.0, "Poor": 35.0, "Very Poor": 10.0, "New-to-Credit": 50.0},
    "foir_limit": {"salaried": 0.55, "self_employed": 0.45, "business": 0.45},
    "card_rate": 0.05,
    "annual_rate_percent": 8.5,
    "enquiry_limit": 3,
    "income_multiple": {"salaried": 6, "self_employed": 5, "business": 5},
    "reject_below": 550,
    "foir_reject_overshoot": 0.15,
    "compensating_headroom": 0.10,
    "weights": {"band": 0.45, "foir": 0.35, "flags": 0.20},
    "severe_penalty": 30.0,
    "mild_penalty": 12.0,
    "confidence": {"base": 0.90, "no_history": 0.30, "per_flag": 0.05, "floor": 0.30},
}
FLAGS = ("settled_account", "written_off_account", "dpd_over_90", "loan_stacking", "income_to_loan_mismatch")
BUREAU_SOURCES = ("bureau", "applicant_declared", "simulated", "demo_fixture")
UNVERIFIED = ("applicant_declared", "simulated", "demo_fixture")
COMPLIANCE = {"name_threshold": 90.0, "metro_ceiling": 3_500_000.0, "non_metro_ceiling": 2_500_000.0, "base": 0.90, "per_critical": 0.15, "per_other": 0.05, "floor": 0.30}
RISK_WEIGHTS = {"credit": 0.25, "foir": 0.20, "ltv": 0.15, "property": 0.15, "documents": 0.15, "stability": 0.10}
DECISION = {"confidence": 0.85, "approve": 80.0, "deny": 40.0, "income_tolerance": 10.0, "value_tolerance": 5.0}
COMPLETENESS_WEIGHTS = {"locality": 20, "price_inr": 20, "area_sqft": 15, "bedrooms": 10, "bathrooms": 5, "furnishing": 5, "floor": 5, "total_floors": 5, "property_age": 5, "parking": 5, "pincode": 5}
#: What a listing of a kind typically has, where it doesn't say.
BATHROOMS = {1: 1, 2: 2, 3: 2, 4: 3, 5: 4}
FURNISHING = {"Apartment": "Unfurnished", "Villa": "Semi-Furnished", "Independent House": "Unfurnished", "Plot": "Unfurnished"}
PARKING = {"Apartment": 1, "Villa": 2, "Independent House": 2, "Plot": 0}
TOTAL_FLOORS = {"Apartment": 10, "Villa": 2, "Independent House": 2, "Plot": 1}
AGE = 5
#: Postal codes of localities.
PINCODES = {
    "whitefield": "560066", "indiranagar": "560038", "koramangala": "560034", "hsr layout": "560102", "electronic city": "560100", "btm layout": "560076", "jayanagar": "560041",
    "malleshwaram": "560003", "rajajinagar": "560010", "hebbal": "560024", "yelahanka": "560064", "marathahalli": "560037", "sarjapur": "560035", "bannerghatta": "560083",
    "devanahalli": "562110", "bagalur": "562149", "hoskote": "562114", "thanisandra": "560077", "mathikere": "560054", "yeshwanthpur": "560022", "vijayanagar": "560040",
    "j.p. nagar": "560078", "frazer town": "560005", "richmond town": "560025", "shivajinagar": "560001", "mg road": "560001", "residency road": "560025", "langford road": "560025",
    "richmond road": "560025", "lavelle road": "560001", "infantry road": "560001", "commercial street": "560001", "majestic": "560023", "kr market": "560002", "peenya": "560058",
    "basaveshwaranagar": "560079", "nagarbhavi": "560072", "mysore road": "560026", "kengeri": "560060", "uttarahalli": "560061", "chamarajpet": "560018", "chickpet": "560053",
    "gandhinagar": "560009", "cox town": "560005", "sanjay nagar": "560094", "kr puram": "560036", "hosur road": "560100", "jigani": "560105", "anekal": "562106",
    "tumkur road": "562106", "kanakapura road": "560062", "bannerghatta road": "560083",
}
