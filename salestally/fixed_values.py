"""Names, tables, patterns and limits that results depend on.

Everything in this module is data, stated as text and in its natural order.
The code elsewhere reads these tables; changing a value here changes results.
"""

# --- default parameters -------------------------------------------------
DEFAULT_YEAR = 2024
PARAM_FIELDS = ("year", "month", "store", "state", "channel", "fromdate", "todate")
YEAR_RANGE = (2020, 2030)
MONTH_RANGE = (1, 12)
STORE_MAX_LENGTH = 10

# --- stores: name -> id -------------------------------------------------
STORE_IDS = {
    "Love Library": "717",
    "Willis Library": "718",
    "Healey Library": "719",
    "Oviatt Library": "720",
    "William T. Young Library": "721",
    "Albertsons Library": "722",
    "Joyner Library": "723",
    "McWherter Library": "724",
    "Fenwick Library": "725",
    "Ablah Library": "726",
    "Ralph Brown Draughon Library": "727",
    "Rasmuson Library": "728",
    "John C. Hodges Library": "729",
    "Robert E. Kennedy Library": "730",
    "Bracken Library": "731",
    "Jerome Library": "732",
    "J. Murrey Atkins Library": "733",
    "Homer Babbidge Library": "734",
    "Meriam Library": "735",
    "Miller Nichols Library": "736",
}

# --- brand, category, sub-category and product codes --------------------
BRAND_CODES = {
    "Routledge Publications": "ROUTLEDGE",
    "HathiTrust Digital Library": "HATHITRUST",
    "CRC Press": "CRC",
    "Princeton University Press": "PRINCETON",
    "Project Gutenberg": "GUTENBERG",
    "Secker & Warburg": "SECKER",
    "Cengage Learning": "CENGAGE",
    "American Mathematical Society": "AMS",
    "McGraw-Hill Education": "MCGRAW",
    "University of Chicago Press": "CHICAGO",
}
CATEGORY_CODES = {
    "E-Books": "EBOOKS",
    "Journals": "JOURNALS",
    "Knowledge Collection": "KNOWLEDGE",
    "Study Vault": "STUDY",
    "Golden Pages": "GOLDEN",
    "Archives": "ARCHIVES",
    "Media": "MEDIA",
}
SUBCATEGORY_CODES = {
    "Non-Fiction": "NONFICTION",
    "Science Journals": "SCIENCE_JOURNALS",
    "Audio Books": "AUDIOBOOKS",
    "Fiction": "FICTION",
    "Humanities Journals": "HUMANITIES_JOURNALS",
    "Social Science Journals": "SOCIAL_JOURNALS",
    "Educational Software": "EDU_SOFTWARE",
}
PRODUCT_CODES = {
    "MATLAB": "MATLAB_SOFTWARE",
    "SAS": "SAS_SOFTWARE",
    "Adobe Creative Suite": "ADOBE_CREATIVE",
    "Ansys": "ANSYS_SOFTWARE",
    "Advanced Calculus": "ADV_CALCULUS",
}

# --- drill-through: widget title -> target, target -> filter kind --------
DRILL_TARGETS = {
    "Top Stores by Sales": "Love Library",
    "Top Brands by Sales": "Routledge Publications",
    "Top Categories by Sales": "E-Books",
    "Top Sub Categories by Sales": "Non-Fiction",
    "Top Products by Sales": "MATLAB",
    "Weekly Trends": "Week1",
}
FILTER_KINDS = {
    **{store: "store" for store in STORE_IDS},
    "Routledge Publications": "none",
    "E-Books": "none",
    "Non-Fiction": "none",
    "MATLAB": "none",
    "Week1": "weekly",
}
DRILL_PARAMS = {
    "Love Library": {"year": 2024, "store": "717"},
    "Willis Library": {"year": 2024, "store": "718"},
    "Routledge Publications": {"year": 2024},
    "E-Books": {"year": 2024},
    "Non-Fiction": {"year": 2024},
    "MATLAB": {"year": 2024},
    "Week1": {"year": 2024},
}
# (widget title, target or None for the widget's default, query)
DRILL_QUERIES = [
    ("Top Stores by Sales", "Love Library", "SP_SalesTrend"),
    ("Top Stores by Sales", None, "SP_SalesTrend"),
    ("Top Brands by Sales", "Routledge Publications", "SP_TopBrandsBySales"),
    ("Top Brands by Sales", None, "SP_TopBrandsBySales"),
    ("Top Categories by Sales", "E-Books", "SP_TopProductsBySales"),
    ("Top Categories by Sales", None, "SP_TopProductsBySales"),
    ("Top Sub Categories by Sales", "Non-Fiction", "SP_WeekdayWeekendSales"),
    ("Top Sub Categories by Sales", None, "SP_WeekdayWeekendSales"),
    ("Top Products by Sales", "MATLAB", "SP_TopProductsBySales"),
    ("Top Products by Sales", None, "SP_TopProductsBySales"),
    ("Weekly Trends", "Week1", "SP_WeekwiseSalesComparison"),
    ("Weekly Trends", None, "SP_WeekwiseSalesComparison"),
]
# queries of the one-store bundle and of the multi-query drill-through
STORE_BUNDLE = [
    "SP_SalesTrend",
    "SP_TopPerformingEmployee",
    "SP_TopProductsBySales",
    "SP_WeekdayWeekendSales",
    "SP_WeekwiseSalesComparison",
]
DRILL_BUNDLE = [
    "SP_SalesTrend",
    "SP_WeekwiseSalesComparison",
    "SP_WeekdayWeekendSales",
    "SP_TopProductsBySales",
]
DRILL_PROBE = [
    "SP_SalesTrend",
    "SP_TopBrandsBySales",
    "SP_TopPerformingEmployee",
    "SP_TopProductsBySales",
    "SP_WeekdayWeekendSales",
    "SP_WeekwiseSalesComparison",
]

# --- sheets and the queries behind them ---------------------------------
SHEET_NAME_LENGTH = 31
LANDING_SHEETS = {
    "Sales Summary_Top Stores by Sal": "SP_TopStoresbySales",
    "Sales Summary_Top Brands by Sal": "SP_TopBrandsBySales",
    "Sales Summary_Top Categories by": "SP_TopCategoriesBySaleswidget",
    "Sales Summary_Top Sub Categorie": "SP_TopSubCategoriesBySales",
    "Sales Summary_Top Products by S": "SP_TopProductsBySaleswidget",
    "Sales Summary_Weekly Trends": "SP_WeeklyTrendswidget",
    "Sales Summary_Store Sales with": "SP_StorewiseActualVsTarget_Vertical_SortedByActual",
}
SHEET_PRIORITY = {
    "landing_page": [
        "Sales Summary_Weekly Trends",
        "Sales Summary_Top Products by S",
        "Sales Summary_Top Brands by Sal",
        "Sales Summary_Top Categories by",
        "Sales Summary_Top Sub Categorie",
        "Sales Summary_Top Stores by Sal",
        "Sales Summary_Store Sales with",
    ],
    "drillthrough": [
        "Sales Summary_Weekday Weekend",
        "Sales Summary_Weekwise Sales",
        "Sales Summary_Sales Trends",
        "Sales Summary_Sales by Product",
        "Sales Summary_Top Performing Employee",
    ],
}
DRILL_SHEETS = {
    "monthly_trends": "Sales Summary_Sales Trends",
    "weekday_weekend": "Sales Summary_Weekday Weekend",
    "weekly_trends": "Sales Summary_Weekwise Sales",
    "product_sales": "Sales Summary_Sales by Product",
    "brand_sales": "Sales Summary_Top Brands by Sales",
    "employee_performance": "Sales Summary_Top Performing Employee",
}
WEEKLY_ALIAS_SHEET = "Weekly Trends"
WEEKDAY_SHEET = "Sales Summary_Weekday Weekend"
SALES_SUFFIX = " SALES"
EXPORT_FILE_PATTERN = "Sales Summary_*"
KPI_FILE_WORD = "kpi"

# --- KPI names and the queries behind them ------------------------------
LANDING_KPIS = {
    "Total Sales": "N_GetFilteredSalesData",
    "Total Units Sold": "SP_TotalUnitsSoldkpi",
    "Total No. of Bills": "SP_TotalBillsKPI",
    "Avg. Bill Value": "SP_AvgBillValue",
    "Avg. Daily Sales": "SP_AvgDailySalesKPI",
    "Total Customers": "TotalCustomersKPI",
    "New Customers": "SP_NewCustomersKPI",
    "Sales per Sqft": "SalesPerSqftKPI",
}
DRILL_KPIS = {
    "Total Sales": "DR_Totalsaleskpi",
    "Total Units Sold": "DR_TotalUnitsSoldKPI",
    "Avg. Bill Value": "DR_avgbillvalue",
    "Total No. of Bills": "DR_Totalnobillsa",
    "Total Customers": "DR_totalcustomers",
}

# --- catalogue: the queries tried for an unknown sheet, in order ---------
CATALOGUE = [
    "SP_SalesTrend",
    "SP_TopPerformingEmployee",
    "SP_TopProductsBySales",
    "SP_WeekdayWeekendSales",
    "SP_WeekwiseSalesComparison",
    "SP_TopStoresbySales",
    "SP_TopBrandsBySales",
    "SP_TopCategoriesBySaleswidget",
    "SP_TopSubCategoriesBySales",
    "SP_WeeklyTrendswidget",
    "SP_StorewiseActualVsTarget_Vertical_SortedByActual",
]

# --- return columns per output shape ------------------------------------
RETURN_COLUMNS = {
    "monthly_trends": ["Month", "CurrentYearSales", "PreviousYearSales"],
    "weekly_trends": ["Week", "CurrentYearSales", "PreviousYearSales"],
    "weekday_weekend": ["WeekCategory", "CurrentYearSales", "PreviousYearSales"],
    "product_sales": ["ProductName", "Sales"],
    "brand_sales": ["BrandName", "Sales"],
    "store_sales": ["Identifier", "Actual Sales"],
    "employee_performance": ["EmployeeName", "Sales"],
    "metric_value_pairs": ["Identifier", "Metric", "Excel Value"],
    "category_sales": ["CategoryName", "Sales"],
    "kpi_single_value": ["Value"],
    "kpi_with_metadata": ["KPI_Name", "Value", "Period"],
    "kpi_comparison": ["Current_Value", "Previous_Value", "Change_Percent"],
}

# --- header words -> tag ------------------------------------------------
HEADER_TAGS = [
    ("monthly_data", ["month", "monthly"]),
    ("weekly_data", ["week", "weekly"]),
    ("weekday_weekend_data", ["weekday", "weekend"]),
    ("product_data", ["product"]),
    ("brand_data", ["brand"]),
    ("store_data", ["store"]),
    ("employee_data", ["employee"]),
    ("category_data", ["category"]),
    ("sales_data", ["sales", "revenue"]),
    ("target_data", ["target"]),
    ("year_comparison", ["current year", "previous year"]),
]
NO_TAG = "generic_data"

# --- tags that speak for an output shape --------------------------------
EXPECTED_TAGS = {
    "monthly_trends": ["monthly_data", "sales_data", "year_comparison"],
    "weekly_trends": ["weekly_data", "sales_data", "year_comparison"],
    "weekday_weekend": ["weekday_weekend_data", "sales_data"],
    "product_sales": ["product_data", "sales_data"],
    "brand_sales": ["brand_data", "sales_data"],
    "store_sales": ["store_data", "sales_data"],
    "employee_performance": ["employee_data", "sales_data"],
    "metric_value_pairs": ["target_data", "sales_data"],
    "generic": ["sales_data"],
}

# --- regular expressions over "sheet name + headers" -> suggested query ---
NAME_PATTERNS = [
    (r"sales.*trend|trend.*sales|month.*sales", "SP_SalesTrend"),
    (r"week.*sales|weekly.*sales|weekwise", "SP_WeekwiseSalesComparison"),
    (r"weekday|weekend|day.*type", "SP_WeekdayWeekendSales"),
    (r"product.*sales|sales.*product", "SP_TopProductsBySales"),
    (r"brand.*sales|sales.*brand", "SP_TopBrandsBySales"),
    (r"store.*sales|sales.*store", "SP_TopStoresbySales"),
    (r"employee|performing", "SP_TopPerformingEmployee"),
    (r"categor.*sales|sales.*categor", "SP_TopCategoriesBySaleswidget"),
    (r"target.*actual|actual.*target", "SP_StorewiseActualVsTarget_Vertical_SortedByActual"),
]
PATTERN_CONFIDENCE = 0.8
FALLBACK_SUGGESTION = ("sales", "SP_TopProductsBySales", 0.5)

# --- sheet-name words that name a query directly -------------------------
DIRECT_NAMES = [
    ("store sales", "SP_TopStoresbySales"),
    ("top stores", "SP_TopStoresbySales"),
    ("brands", "SP_TopBrandsBySales"),
    ("top brands", "SP_TopBrandsBySales"),
    ("categories", "SP_TopCategoriesBySaleswidget"),
    ("top categories", "SP_TopCategoriesBySaleswidget"),
    ("sub categories", "SP_TopSubCategoriesBySales"),
    ("products", "SP_TopProductsBySales"),
    ("top products", "SP_TopProductsBySales"),
    ("weekly trends", "SP_WeeklyTrendswidget"),
    ("weekly", "SP_WeeklyTrendswidget"),
    ("sales trends", "SP_SalesTrend"),
    ("month", "SP_SalesTrend"),
]
TARGET_SHEET_NAME = ("store sales", "SP_StorewiseActualVsTarget_Vertical_SortedByActual")

# --- match scores, in tenths --------------------------------------------
SCORE_DIRECT = 8
SCORE_TAGS = 4
SCORE_VOLUME = 1
SCORE_COLUMNS = 1
SCORE_CAP = 10
SCORE_FLOOR = 3
# query, words the sheet name has, words it lacks, target tag (yes/no/any), tenths
SCORE_BOOSTS = [
    ("SP_StorewiseActualVsTarget_Vertical_SortedByActual", ["store"], [], "yes", 9),
    ("SP_TopStoresbySales", ["store"], [], "no", 5),
    ("SP_TopBrandsBySales", ["brand"], [], "any", 5),
    ("SP_TopCategoriesBySaleswidget", ["categor"], ["sub"], "any", 5),
    ("SP_TopSubCategoriesBySales", ["sub categor"], [], "any", 7),
    ("SP_TopProductsBySales", ["product"], [], "any", 5),
    ("SP_WeeklyTrendswidget", ["weekly trends"], [], "any", 9),
    ("SP_WeeklyTrendswidget", ["weekly"], [], "any", 7),
    ("SP_WeekwiseSalesComparison", ["weekly"], ["trends"], "any", 6),
    ("SP_SalesTrend", ["sales trend"], [], "any", 5),
    ("SP_SalesTrend", ["trend"], ["weekly"], "any", 5),
]

# --- widget title words -> query (first hit) -----------------------------
TITLE_WORDS = [
    (["Store", "Sales"], "SP_TopStoresbySales"),
    (["Brand", "Sales"], "SP_TopBrandsBySales"),
    (["Categories", "Sales"], "SP_TopCategoriesBySaleswidget"),
    (["Sub Categories", "Sales"], "SP_TopSubCategoriesBySales"),
    (["Product", "Sales"], "SP_TopProductsBySaleswidget"),
    (["Weekly"], "SP_WeeklyTrendswidget"),
    (["Trends"], "SP_WeeklyTrendswidget"),
    (["Store", "Target"], "SP_StorewiseActualVsTarget_Vertical_SortedByActual"),
]
TITLE_DEFAULT = "SP_TopStoresbySales"

# --- row rules -----------------------------------------------------------
REQUIRED_COLUMNS = {
    "store_sales": ["Identifier", "Actual Sales"],
    "brand_sales": ["Identifier", "Actual Sales"],
    "category_sales": ["Identifier", "Actual Sales"],
    "product_sales": ["Identifier", "Actual Sales"],
    "weekly_trends": ["Identifier", "Previous Year", "Current Year"],
    "monthly_trends": ["Identifier", "Previous Year", "Current Year"],
    "weekday_weekend": ["Identifier/Label", "Metric", "Excel Value"],
    "employee_performance": ["Identifier", "Sales"],
}
SALES_RANGE = ("0", "999999999.99")

# --- month names; the short form is the first three letters -------------
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# --- value cleaning and display -----------------------------------------
COMPARE_STRIP = ",$₹KM"
NORMALISE_STRIP = ",$₹%"
SUFFIX_SCALE = {"K": 1000, "M": 1000000, "B": 1000000000}
NULL_WORDS = ["none", "null", "nan", ""]
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DECIMAL_PLACES = 2
CURRENCY_SYMBOL = "$"
NULL_DISPLAY = "N/A"
NOT_FOUND = "Not Found"
NULL_TEXT = "None"
UNKNOWN = "Unknown"

# --- KPI status ladder: database text, status, note ----------------------
KPI_SENTINELS = [
    ("Not Found", "No SP Mapping", "No stored procedure mapped for this KPI"),
    ("SP Not Found", "SP Missing", "Stored procedure does not exist in database"),
    ("DB Error", "DB Error", "Database error occurred"),
]
KPI_MATCH_NOTE = "Values match perfectly"
KPI_MISMATCH_NOTE = "Values do not match"
NO_RESULT = "No Result"
NO_DATA = "No Data"

# --- SQL type names -> Spark type and null default ------------------------
SQL_TYPES = {
    "int": ("int", 0),
    "bigint": ("bigint", 0),
    "decimal": ("decimal(38,6)", 0.0),
    "numeric": ("decimal(38,6)", 0.0),
    "float": ("double", 0.0),
    "real": ("double", 0.0),
    "varchar": ("string", ""),
    "nvarchar": ("string", ""),
    "char": ("string", ""),
    "nchar": ("string", ""),
    "text": ("string", ""),
    "ntext": ("string", ""),
    "datetime": ("timestamp", None),
    "datetime2": ("timestamp", None),
    "date": ("date", None),
    "time": ("string", None),
    "bit": ("boolean", False),
}
