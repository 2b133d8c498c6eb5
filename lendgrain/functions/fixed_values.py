"""Fixed values of the credit bureaus: account types, product codes, ratings, phrases.

These are given vocabularies; results are only right if they are spelled exactly like this.
"""

# --- bureau A, enquiries: purpose text -> product ---------------------------------------------
ENQUIRY_PRODUCT = {
    "AL": ["Tractor Loan", "Used Car Loan", "P2P Auto Loan", "Auto Loan (Personal)"],
    "PL": ["Loan On Credit Card", "Loan To Professional", "Microfinance Personal Loan", "Personal Loan",
           "Microfinance Others", "P2P Personal Loan"],
    "GL": ["Gold Loan"],
    "CC": ["Corporate Credit Card", "Credit Card", "Fleet Card", "Kisan Credit Card",
           "Loan Against Bank Deposits", "Secured Credit Card"],
    "BL": ["Business Loan - Secured", "Business Loan - General",
           "Business Loan - Priority Sector - Small Business", "Business Loan - Priority Sector - Agriculture",
           "Business Loan - Priority Sector - Others", "Business Non-Funded Credit Facility - General",
           "Business Non - Funded Credit Facility - Priority Sector - Small Business",
           "Business Non - Funded Credit Facility - Priority Sector - Agriculture",
           "Business Non - Funded Credit Facility - Priority Sector - Others",
           "Business Loan Against Bank Deposits", "Business Loan - Unsecured",
           "Mudra Loans - Shishu/Kishor/Tarun", "GECL Loan Unsecured", "GECL Loan Secured",
           "Microfinance Business Loan"],
    "OD": ["Overdraft", "Prime Minister Jaan Dhan Yojana - Overdraft"],
    "CD": ["Consumer Loan"],
    "HL": ["Housing Loan", "Microfinance - Housing Loan",
           "Pradhan Mantri Awas Yojana - Credit Link Subsidy Scheme MAY CLSS"],
    "EL": ["Education Loan", "P2P Education Loan"],
    "CE": ["Construction Equipment Loan"],
    "LAP": ["Property Loan"],
    "LAS": ["Loan Against Shares/Securities"],
    "TW": ["Two - Wheeler Loan"],
    "CV": ["Commercial Vehicle Loan"],
    "Other": ["Leasing", "Non - Funded Credit Facility", "Other"],
}

# purposes counted as secured (note: some microfinance purposes are)
ENQUIRY_SECURED = [
    "Auto Loan (Personal)", "Housing Loan", "Property Loan", "Loan Against Shares/Securities", "Gold Loan",
    "Leasing", "Two - Wheeler Loan", "Loan Against Bank Deposits", "Commercial Vehicle Loan",
    "GECL Loan Secured", "Secured Credit Card", "Used Car Loan", "Construction Equipment Loan",
    "Tractor Loan", "Microfinance Business Loan", "Microfinance Personal Loan",
    "Microfinance - Housing Loan", "Microfinance Others", "P2P Auto Loan",
    "Pradhan Mantri Awas Yojana - Credit Link Subsidy Scheme MAY CLSS", "Business Loan - Secured",
    "Business Loan - General", "Business Loan - Priority Sector - Small Business",
    "Business Loan - Priority Sector - Agriculture", "Business Loan - Priority Sector - Others",
    "Business Non-Funded Credit Facility - General",
    "Business Non - Funded Credit Facility - Priority Sector - Small Business",
    "Business Non - Funded Credit Facility - Priority Sector - Agriculture",
    "Business Non - Funded Credit Facility - Priority Sector - Others",
    "Business Loan Against Bank Deposits", "Priority Sector - Gold Loan",
]

# purposes left out of the "unsecured enquiries in three months" velocity feature
ENQUIRY_VELOCITY_SECURED = [
    "Auto Loan (Personal)", "Business Loan - Secured", "Business Loan Against Bank Deposits",
    "Business Non-Funded Credit Facility - General", "Commercial Vehicle Loan", "Construction Equipment Loan",
    "GECL Loan Secured", "Gold Loan", "Housing Loan", "Loan Against Bank Deposits",
    "Loan Against Shares/Securities", "Microfinance - Housing Loan",
    "Pradhan Mantri Awas Yojana - Credit Link Subsidy Scheme MAY CLSS", "Property Loan",
    "Secured Credit Card", "Tractor Loan", "Two-wheeler Loan", "Used Car Loan",
]
ENQUIRY_NOT_CREDIT = ["Auto Lease", "Other"]

# --- bureau A, accounts: account type text -> product -----------------------------------------
ACCOUNT_PRODUCT = {
    "AL": ["Tractor Loan", "Used Car Loan", "P2P Auto Loan", "Auto Loan (Personal)"],
    "PL": ["Loan On Credit Card", "Loan to Professional", "Microfinance Personal Loan", "Personal Loan",
           "Microfinance Others", "P2P Personal Loan"],
    "GL": ["Gold Loan"],
    "CC": ["Corporate Credit Card", "Credit Card", "Fleet Card", "Kisan Credit Card",
           "Loan Against Bank Deposits", "Secured Credit Card"],
    "BL": ["Business Loan - Secured", "Business Loan - General",
           "Business Loan - Priority Sector - Small Business", "Business Loan - Priority Sector - Agriculture",
           "Business Loan - Priority Sector - Others", "Business Non - Funded Credit Facility - General",
           "Business Non - Funded Credit Facility - Priority Sector - Small Business",
           "Business Non - Funded Credit Facility - Priority Sector - Agriculture",
           "Business Non - Funded Credit Facility - Priority Sector - Others",
           "Business Loan Against Bank Deposits", "Business Loan - Unsecured",
           "Mudra Loans - Shishu/Kishor/Tarun", "GECL Loan Unsecured", "GECL Loan Secured",
           "Microfinance Business Loan"],
    "OD": ["Overdraft", "Prime Minister Jaan Dhan Yojana - Overdraft"],
    "CD": ["Consumer Loan"],
    "HL": ["Housing Loan", "Microfinance Housing Loan",
           "Pradhan Mantri Awas Yojana - Credit Link Subsidy Scheme MAY CLSS"],
    "EL": ["Education Loan", "P2P Education Loan"],
    "CE": ["Construction Equipment Loan"],
    "LAP": ["Property Loan"],
    "LAS": ["Loan Against Shares/Securities"],
    "TW": ["Two-wheeler Loan"],
    "CV": ["Commercial Vehicle Loan"],
    "Other": ["Leasing", "Non - Funded Credit Facility", "Other"],
}
ACCOUNT_SECURED = [
    "Auto Loan (Personal)", "Housing Loan", "Property Loan", "Loan Against Shares/Securities", "Gold Loan",
    "Leasing", "Two-wheeler Loan", "Loan Against Bank Deposits", "Commercial Vehicle Loan",
    "GECL Loan Secured", "Secured Credit Card", "Used Car Loan", "Construction Equipment Loan",
    "Tractor Loan", "Microfinance Business Loan", "Microfinance Personal Loan",
    "Microfinance Housing Loan", "Microfinance Others", "P2P Auto Loan",
    "Pradhan Mantri Awas Yojana - Credit Link Subsidy Scheme MAY CLSS", "Business Loan - Secured",
    "Business Loan - General", "Business Loan - Priority Sector - Small Business",
    "Business Loan - Priority Sector - Agriculture", "Business Loan - Priority Sector - Others",
    "Business Non - Funded Credit Facility - General",
    "Business Non - Funded Credit Facility - Priority Sector - Small Business",
    "Business Non - Funded Credit Facility - Priority Sector - Agriculture",
    "Business Non - Funded Credit Facility - Priority Sector - Others",
    "Business Loan Against Bank Deposits", "Priority Sector - Gold Loan",
]
ACCOUNT_CARD = ["Corporate Credit Card", "Credit Card", "Kisan Credit Card", "Secured Credit Card"]
ACCOUNT_REVOLVING = ACCOUNT_CARD + [
    "Overdraft", "Prime Minister Jaan Dhan Yojana - Overdraft", "Non - Funded Credit Facility",
    "Business Non - Funded Credit Facility - General",
    "Business Non - Funded Credit Facility - Priority Sector - Small Business",
    "Business Non - Funded Credit Facility - Priority Sector - Agriculture",
    "Business Non - Funded Credit Facility - Priority Sector - Others",
]
# account types whose zero balance does not mean "closed" in the category features
ACCOUNT_ZERO_BALANCE_LIVE = [
    "Credit Card", "Overdraft", "14", "16", "Secured Credit Card", "Corporate Credit Card",
    "Kisan Credit Card", "Business Non - Funded Credit Facility - General",
    "Business Non - Funded Credit Facility - Priority Sector - Small Business", "57", "58",
]

# --- bureau A, data preparation: loan type text -> coarse product ------------------------------
PREP_PRODUCT = {
    "Auto_Loan": ["Auto Loan (Personal)"],
    "Personal_Loan": ["Microfinance - Personal Loan", "Microfinance Personal Loan", "P2P Personal Loan",
                      "Personal Loan"],
    "Gold_Loan": ["Gold Loan"],
    "Credit_Card": ["Corporate Credit Card", "Credit Card", "Secured Credit Card", "Fleet Card"],
    "Business_Loan": ["Business Loan", "Business Loan - General",
                      "Business Loan - Priority Sector - Agriculture",
                      "Business Loan - Priority Sector - Others",
                      "Business Loan - Priority Sector - Small Business", "Business Loan - Unsecured",
                      "Business Loan - Secured", "Business Loan Against Bank Deposits",
                      "Business Non-Funded Credit Facility - General",
                      "Business Non-Funded Credit Facility - Priority Sector - Agriculture",
                      "Business Non-Funded Credit Facility - Priority Sector - Small Business",
                      "Microfinance - Business Loan"],
    "Housing_Loan": ["Home Loan", "Housing Loan", "Microfinance Housing Loan"],
    "Consumer_Loan": ["Consumer Loan"],
    "LAP": ["Property Loan", "LAP"],
    "Two-wheeler_Loan": ["Two-wheeler Loan", "TW"],
    "Commercial_Vehicle": ["Commercial Vehicle Loan", "CV Loan"],
    "Used_Car_Loan": ["Used Car Loan", "UCL"],
}
PREP_SECURED = [
    "Auto Loan (Personal)", "Business Loan Against Bank Deposits", "Commercial Vehicle Loan", "CV LOAN",
    "Construction Equipment Loan", "Gold Loan", "HOME LOAN", "Housing Loan", "Leasing",
    "Loan Against Bank Deposits", "Loan Against Shares/Securities", "Microfinance - Housing Loan",
    "Property Loan", "LAP", "Secured Credit Card", "Tractor Loan", "TW", "Two-wheeler Loan", "UCL",
    "Used Car Loan", "Business Loan - Secured",
]

# --- bureau A, category segments ----------------------------------------------------------------
SEGMENT_PRODUCT = {
    "PL": ["Personal Loan"], "GL": ["Gold Loan"], "CC": ["Credit Card"], "TW": ["Two-wheeler Loan"],
    "AL": ["Auto Loan (Personal)"], "HL": ["Housing Loan"],
}
SEGMENT_NAGRI = [
    "Other", "Auto Loan (Personal)", "Housing Loan", "Property Loan", "Loan Against Shares/Securities",
    "Personal Loan", "Consumer Loan", "Gold Loan", "Education Loan", "Loan to Professional", "Credit Card",
    "Overdraft", "Two-wheeler Loan", "Loan Against Bank Deposits", "Commercial Vehicle Loan",
    "Secured Credit Card", "Used Car Loan", "Construction Equipment Loan", "Corporate Credit Card",
    "Kisan Credit Card", "Business Loan - General", "Business Loan - Priority Sector - Small Business",
    "Business Loan - Priority Sector - Others", "Business Non - Funded Credit Facility - General",
    "Business Non - Funded Credit Facility - Priority Sector - Small Business",
    "Business Loan Against Bank Deposits", "Microfinance Business Loan", "Microfinance Personal Loan",
    "Microfinance Housing Loan", "Microfinance Others", "Business Loan - Unsecured",
]
SEGMENT_SEC = [
    "Auto Loan (Personal)", "Property Loan", "Housing Loan", "Gold Loan", "Two-wheeler Loan",
    "Commercial Vehicle Loan", "Used Car Loan", "Construction Equipment Loan", "Microfinance Housing Loan",
]
SEGMENT_UNSEC = ["Personal Loan", "Consumer Loan", "Credit Card", "Kisan Credit Card",
                 "Loan to Professional", "Microfinance Personal Loan"]

# --- bureau B, accounts -------------------------------------------------------------------------
B_PRODUCT = {
    "AL": ["Auto Lease", "Auto Loan (Personal)", "Tractor Loan", "Used Car Loan"],
    "PL": ["Loan on Credit Card", "Loan to Professional", "Microfinance Personal Loan", "P2P Personal Loan",
           "Personal Loan", "Staff Loan", "Microfinance Others"],
    "GL": ["Gold Loan"],
    "CC": ["Corporate Credit Card", "Credit Card", "Fleet Card", "Kisan Credit Card",
           "Loan Against Bank Deposits", "Secured Credit Card"],
    "BL": ["Business Loan - Secured", "Business Loan Against Bank Deposits", "Business Loan General",
           "Business Loan Priority Sector Agriculture", "Business Loan Priority Sector Others",
           "Business Loan Priority Sector Small Business", "Business Loan Unsecured",
           "Business Non-Funded Credit Facility General",
           "Business Non-Funded Credit Facility-Priority Sector- Small Business",
           "Business Non-Funded Credit Facility-Priority Sector-Agriculture",
           "Business Non-Funded Credit Facility-Priority Sector-Others", "GECL Loan secured",
           "GECL Loan unsecured", "Microfinance Business Loan", "Mudra Loans - Shishu / Kishor / Tarun"],
    "OD": ["Overdraft", "Prime Minister Jaan Dhan Yojana - Overdraft"],
    "CD": ["Consumer Loan"],
    "HL": ["Housing Loan", "Microfinance Housing Loan", "Pradhan Mantri Awas Yojana - CLSS"],
    "EL": ["Education Loan"],
    "CE": ["Commercial Equipment Loan", "Construction Equipment Loan"],
    "LAP": ["Property Loan"],
    "LAS": ["Loan Against Shares / Securities"],
    "TW": ["Two-Wheeler Loan"],
    "CV": ["Commercial Vehicle Loan"],
    "Other": ["Leasing", "Non-Funded Credit Facility", "Other", "Telco Wireless"],
}
B_SECURED = [
    "Auto Loan (Personal)", "Business Loan - Secured", "Business Loan Against Bank Deposits",
    "Business Loan General", "Commercial Equipment Loan", "Commercial Vehicle Loan", "GECL Loan secured",
    "Gold Loan", "Housing Loan", "Leasing", "Loan Against Bank Deposits", "Loan Against Shares / Securities",
    "Microfinance Housing Loan", "Pradhan Mantri Awas Yojana - CLSS", "Property Loan",
    "Secured Credit Card", "Tractor Loan", "Two-Wheeler Loan", "Used Car Loan",
]
B_REVOLVING = [
    "Business Non-Funded Credit Facility General",
    "Business Non-Funded Credit Facility-Priority Sector- Small Business",
    "Business Non-Funded Credit Facility-Priority Sector-Agriculture",
    "Business Non-Funded Credit Facility-Priority Sector-Others", "Corporate Credit Card", "Credit Card",
    "Kisan Credit Card", "Secured Credit Card", "Overdraft",
    "Prime Minister Jaan Dhan Yojana - Overdraft", "Non-Funded Credit Facility",
]

# --- bureau C, numeric account type codes ---------------------------------------------------------
C_ENQUIRY_PRODUCT = {
    "AL": [2], "PL": [11, 13], "CC": [7], "BL": [1, 3, 12], "CD": [6, 18], "EL": [8], "CE": [5],
    "LAP": [14], "LAS": [10], "TW": [16], "CV": [4], "Other": [9, 15, 99],
}
C_ENQUIRY_SECURED = [2, 3, 4, 5, 9, 10, 14, 16]
C_ENQUIRY_REVOLVING = [7, 12, 15]
C_PRODUCT = {
    "AL": [47, 221, 223],
    "BL": [248, 249, 167, 175, 176, 177, 178, 179, 197, 198, 199, 200, 227, 228, 241],
    "CC": [5, 214, 220, 213, 224], "CD": [189], "CE": [222], "CV": [172], "EL": [130], "GL": [191, 243],
    "HL": [58, 168, 240], "LAP": [195], "LAS": [185], "OD": [121, 226, 244],
    "PL": [123, 187, 169, 170, 245, 246, 247, 196, 225, 242], "TW": [173],
    "Other": [219, 181, 217, 215, 216, 999, 184],
}
C_SECURED = [47, 58, 195, 185, 191, 219, 173, 184, 172, 248, 168, 246, 176, 175, 220, 221, 223, 240, 241, 243]
C_REVOLVING = [5, 121, 181, 214, 197, 198, 199, 200, 220, 213, 224, 225, 226, 244]

# bureau C payment rating -> delinquency bucket (anything else is -1; there is no bucket 1)
C_RATING_BUCKET = {
    "?": -1, "-1": -1, "U": -1, "0": 0, "S": 0, "1": 2, "2": 3, "3": 4, "4": 4,
    "B": 4, "D": 4, "L": 4, "M": 4, "5": 5, "6": 6,
}
C_WRITTEN_OFF_STATUS = ["00", "01", "02", "03", "04", "06", "08", "09", "10", "11", "12", "13", "14", "15", "16"]
LENDER_CLASSES = ["PVT", "HFC", "NBF", "PUB", "FOR"]

# --- delinquency buckets --------------------------------------------------------------------------
# lowest days past due of buckets 0..7, and what a bucket stands for when it is turned back into days
DPD_BUCKET_FLOOR = [0, 1, 30, 60, 90, 150, 180, 360]
DPD_BUCKET_DAYS = [0, 1, 30, 60, 90, 150, 180, 180]
DPD_BUCKET_DAYS_COMPAT = [0, 1, 30, 60, 90, 120, 180, 180]
# asset classification codes that count as a bucket
DPD_SPECIAL = {901: 0, 905: 3, 902: 4, 903: 6, 904: 6}

# --- dictionary phrases that rule a variable out --------------------------------------------------
DESCRIPTION_MONTH_PATTERNS = ["M =", " at month"]
DESCRIPTION_BALANCE_PATTERNS = [
    "Total past due amount", "at month", "Aggregate amount past due", "Average total open-to-buy",
    "Total scheduled monthly payment", "Limit of overdraft of", "Total monthly obligation",
    "Aggregate financial non-mortgage actual payment", "Aggregate financial non-mortgage amount past due",
    "Aggregate bankcard term at month", "Aggregate bankcard Minimum Payment Amount",
    "Aggregate unsecured loan actual payment amount", "Aggregate  actual payment amount at month",
    "Aggregate spend at month", "Aggregate revolving spend at month", "Aggregate retail spend at month",
    "Total payment amount", "Min total open-to-buy for", "Aggregate spend over the",
    "Peak monthly spend over the", "Aggregate retail spend over the", "Delinquent Ammount",
    "Total open to buy of", "Aggregate unsecured loan amount past due", "Aggregate excess payment",
    "Total past due amount of", "Average balance of", "Total balance of", "Max total open-to-buy",
    "Total credit line of", "Aggregate balance at", "Aggregate unsecured loan balance",
    "Aggregate credit line at", "Aggregate financial non-mortgage balance",
    "Aggregate bankcard amount past", "Highest balance of", "Maximum balance owed",
]
BLACKLIST_CODES = [1, 2, 3, 4, 6]

# interpretation bands
IV_BANDS = [(0.02, "not useful"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong"), (None, "suspicious")]
PSI_BANDS = [(0.1, "stable"), (0.2, "monitor"), (None, "retrain")]
