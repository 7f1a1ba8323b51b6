"""Input views over the given tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: View name -> its query; a view may use those before it.
VIEWS = {
    "applications": """
WITH b AS (
  SELECT o.o_orderkey AS application_id, o.o_orderdate AS created_at, o.o_orderstatus,
    c.c_custkey AS custkey, CASE WHEN c.c_custkey % 37 = 0 THEN NULL ELSE r.r_name END AS audit_group,
    concat(CASE c.c_custkey % 5 WHEN 0 THEN 'Aven' WHEN 1 THEN 'Mira' WHEN 2 THEN 'Ishan' WHEN 3 THEN 'Tara' ELSE 'Nikhil' END, ' ',
           CASE c.c_custkey % 7 WHEN 0 THEN 'Rilora' WHEN 1 THEN 'Solvani' WHEN 2 THEN 'Verali' WHEN 3 THEN 'Dhanor' WHEN 4 THEN 'Kestur' WHEN 5 THEN 'Palvem' ELSE 'Orinda' END) AS name,
    CASE c.c_mktsegment WHEN 'BUILDING' THEN 'Salaried' WHEN 'AUTOMOBILE' THEN 'employee' WHEN 'MACHINERY' THEN 'Business'
         WHEN 'FURNITURE' THEN 'self-employed' ELSE ' Salary ' END AS employment_type,
    CAST(CASE WHEN o.o_orderkey % 211 = 0 THEN 0 ELSE 40000 + ((c.c_custkey * 37) % 221) * 1000 END AS DOUBLE) AS monthly_income,
    CAST(10 * CAST(floor(o.o_totalprice) AS BIGINT) AS DOUBLE) AS loan_amount,
    CAST(CASE WHEN o.o_orderkey % 223 = 0 THEN 0 ELSE 120 + 12 * (o.o_orderkey % 16) END AS INT) AS loan_tenure_months,
    CAST(40 + 5 * (o.o_orderkey % 13) AS INT) AS ltv_pct,
    CAST((c.c_custkey % 8) * 2500 AS DOUBLE) AS existing_debt,
    CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE CAST(520 + (c.c_custkey * 61 + o.o_orderkey * 7) % 360 AS INT) END AS cibil_score,
    CASE WHEN o.o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS settled_accounts,
    CASE WHEN o.o_orderkey % 41 = 0 THEN 1 ELSE 0 END AS written_off_accounts,
    CAST(CASE WHEN o.o_orderkey % 19 = 0 THEN 120 ELSE (o.o_orderkey % 4) * 15 END AS INT) AS max_dpd_last_12_months,
    CAST(c.c_custkey % 5 AS INT) AS recent_enquiries_last_90_days,
    CAST((o.o_orderkey % 20) * 5000 AS DOUBLE) AS credit_card_outstanding_total,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'bureau' WHEN '2-HIGH' THEN 'bureau' WHEN '3-MEDIUM' THEN 'applicant_declared'
         WHEN '4-NOT SPECIFIED' THEN 'simulated' ELSE CASE WHEN o.o_orderkey % 3 = 0 THEN 'demo_fixture' ELSE NULL END END AS bureau_source
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)
SELECT *, CAST(round(CAST(loan_amount * 100 / ltv_pct AS DECIMAL(20,8)), 2) AS DOUBLE) AS property_value,
  CASE WHEN o_orderstatus = 'O' THEN NULL
       WHEN (application_id * 13 + custkey) % 100 < (CASE WHEN cibil_score IS NULL THEN 30 WHEN cibil_score < 600 THEN 45 WHEN cibil_score < 700 THEN 25 ELSE 8 END) THEN 1
       ELSE 0 END AS outcome_bad
FROM b
""",
    "case_inputs": """
SELECT a.application_id, a.name, a.monthly_income, a.loan_amount, a.property_value,
  CASE WHEN application_id % 29 = 0 THEN monthly_income * CAST(0.6 AS DOUBLE) WHEN application_id % 11 = 0 THEN monthly_income * CAST(0.85 AS DOUBLE) ELSE monthly_income END AS doc_monthly_income,
  CAST(CASE WHEN application_id % 10 < 7 THEN 0 ELSE 1 + application_id % 3 END AS INT) AS n_missing_documents,
  CAST(60 + 2 * (application_id % 20) AS DOUBLE) / 100 AS extraction_confidence,
  CASE WHEN application_id % 10 < 8 THEN 'verified' ELSE 'partial' END AS verification_status,
  CAST(6 + application_id % 7 AS INT) AS n_provenance,
  property_value * CAST(85 + application_id % 31 AS DOUBLE) / 100 AS estimated_value,
  CAST(30 + 5 * (application_id % 14) AS DOUBLE) / 100 AS valuation_confidence,
  CAST(application_id % 31 AS DOUBLE) AS valuation_variance_percent,
  CASE application_id % 4 WHEN 0 THEN 'registered' WHEN 1 THEN 'REGISTERED' WHEN 2 THEN 'not_registered' ELSE 'UNKNOWN' END AS rera_status,
  application_id % 9 = 0 AS under_construction,
  CASE WHEN application_id % 17 = 0 THEN 'Someone Else' WHEN application_id % 3 = 0 THEN concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) WHEN application_id % 37 = 0 THEN NULL ELSE upper(name) END AS pan_card_name,
  CASE WHEN application_id % 7 = 0 THEN concat(substring(name, 1, 1), '. ', split_part(name, ' ', 2)) ELSE name END AS aadhaar_name,
  concat('ABCP', upper(substring(split_part(name, ' ', 2), 1, 1)), lpad(CAST(application_id % 10000 AS STRING), 4, '0'), 'F') AS form_pan,
  card_pan, form_dob,
  application_id % 43 <> 0 AS pan_present, application_id % 47 <> 0 AS aadhaar_present, application_id % 59 <> 0 AS address_present, application_id % 61 <> 0 AS aadhaar_valid,
  application_id % 67 <> 0 AS source_of_funds_declared, application_id % 13 <> 0 AS identity_verification_logged,
  CASE WHEN application_id % 21 = 0 THEN NULL WHEN application_id % 22 = 0 THEN ' ' WHEN application_id % 2 = 0 THEN 'Pune' ELSE 'Erode' END AS city,
  CASE WHEN application_id % 19 = 0 THEN NULL WHEN application_id % 31 = 0 THEN concat(name, ' Kumar') ELSE name END AS slip_name,
  CASE WHEN application_id % 41 = 0 THEN concat(split_part(name, ' ', 1), ' X') WHEN application_id % 5 = 0 THEN '' ELSE lower(name) END AS bank_name,
  CASE WHEN application_id % 25 = 0 THEN '01 Jan 1990' WHEN application_id % 6 = 0 THEN NULL WHEN application_id % 6 = 1 THEN concat('19', CAST(60 + application_id % 35 AS STRING), '-0', CAST(1 + application_id % 9 AS STRING), '-1', CAST(application_id % 9 AS STRING))
       ELSE concat('1', CAST(application_id % 9 AS STRING), '/', CAST(1 + application_id % 9 AS STRING), '/19', CAST(60 + application_id % 35 AS STRING)) END AS aadhaar_dob,
  application_id % 71 <> 0 AS pan_doc_valid, application_id % 73 <> 0 AS address_readable,
  CASE WHEN application_id % 83 = 0 THEN 'name,Gender,loan_amount' WHEN application_id % 89 = 0 THEN 'religion,caste,name' ELSE 'name,loan_amount,monthly_income' END AS fields_used,
  CASE WHEN application_id % 15 = 0 THEN NULL WHEN application_id % 17 = 0 THEN 600 WHEN application_id % 97 = 0 THEN 950 ELSE cibil_score END AS declared_cibil,
  CASE WHEN application_id % 33 = 0 THEN 'HIGH' WHEN application_id % 35 = 0 THEN 'MEDIUM' WHEN application_id % 107 = 0 THEN 'CRITICAL' END AS reported_severity,
  CASE WHEN application_id % 2 = 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END AS reported_resolution,
  application_id % 109 <> 0 AS has_documents, application_id % 113 <> 0 AS has_property,
  CASE WHEN application_id % 10 = 0 THEN concat('1', CAST(application_id % 9 AS STRING), '/', CAST(1 + application_id % 9 AS STRING), '/19', CAST(50 + application_id % 45 AS STRING))
       WHEN application_id % 10 = 1 THEN CAST(1935 + application_id % 80 AS STRING) WHEN application_id % 10 = 2 THEN concat('0', CAST(1 + application_id % 9 AS STRING), '-1', CAST(application_id % 3 AS STRING), '-', CAST(1950 + application_id % 62 AS STRING))
       WHEN application_id % 10 = 3 THEN 'unknown' WHEN application_id % 10 = 4 THEN NULL WHEN application_id % 10 = 5 THEN '2009-05-06' ELSE form_dob END AS dob_text,
  CASE WHEN application_id % 4 = 0 THEN NULL WHEN application_id % 12 = 1 THEN 'net_salary,employer_name' WHEN application_id % 12 = 3 THEN 'existing_debt,monthly_income,gross_salary' WHEN application_id % 12 = 5 THEN 'full_name' ELSE '' END AS overridden_fields,
  CASE WHEN application_id % 101 = 0 THEN 'BAD123' WHEN application_id % 103 = 0 THEN 'ABCCX1234F' WHEN application_id % 79 = 0 THEN NULL ELSE card_pan END AS pan_text
FROM (SELECT *, concat('19', CAST(60 + application_id % 35 AS STRING), '-0', CAST(1 + application_id % 9 AS STRING), '-1', CAST(application_id % 9 AS STRING)) AS form_dob,
  CASE WHEN application_id % 53 = 0 THEN 'ZZZPZ9999Z' ELSE concat(' abcp', lower(substring(split_part(name, ' ', 2), 1, 1)), ' ', lpad(CAST(application_id % 10000 AS STRING), 4, '0'), 'f') END AS card_pan FROM applications) a
""",
    "bureau_reports": """
SELECT application_id, CASE WHEN application_id % 14 = 0 THEN -1 WHEN application_id % 26 = 0 THEN NULL ELSE CAST(520 + (custkey * 61 + application_id * 7) % 360 AS INT) END AS cibil_score,
  settled_accounts, written_off_accounts, CASE WHEN application_id % 22 = 0 THEN NULL ELSE max_dpd_last_12_months END AS max_dpd_last_12_months, recent_enquiries_last_90_days, credit_card_outstanding_total
FROM applications WHERE application_id % 2 = 0
""",
    "named_documents": """
SELECT application_id, 'PAN Card' AS document, pan_card_name AS name FROM case_inputs WHERE application_id % 3 <> 1
UNION ALL SELECT application_id, 'Aadhaar Card', aadhaar_name FROM case_inputs WHERE application_id % 4 <> 1
UNION ALL SELECT application_id, 'Salary Slip', slip_name FROM case_inputs WHERE application_id % 5 = 0
UNION ALL SELECT application_id, 'Bank Statement', bank_name FROM case_inputs WHERE application_id % 6 = 0
UNION ALL SELECT application_id, 'Letter', name FROM case_inputs WHERE application_id % 7 = 0
""",
    "document_checks": """
SELECT application_id,
  CASE application_id % 5 WHEN 0 THEN 'TCS Ltd' WHEN 1 THEN 'Acme Finance' WHEN 2 THEN 'Acme Finance Pvt' WHEN 3 THEN '' ELSE 'Infosys' END AS slip_employer,
  CASE application_id % 7 WHEN 0 THEN 'Tata Consultancy Services' WHEN 1 THEN 'Acme Finance' WHEN 2 THEN NULL WHEN 3 THEN 'Infy BPM' ELSE 'Other Works' END AS form_employer,
  CASE WHEN application_id % 8 = 0 THEN NULL ELSE CAST(560000 + application_id % 4 AS STRING) END AS kyc_pincode, CAST(560000 + application_id % 3 AS STRING) AS property_pincode,
  CASE WHEN application_id % 9 = 0 THEN '' ELSE concat('12 Main Road, ', CASE WHEN application_id % 2 = 0 THEN 'PUNE' ELSE 'Erode' END) END AS kyc_address, CASE WHEN application_id % 6 = 0 THEN NULL WHEN application_id % 3 = 0 THEN 'Erode' ELSE 'Pune' END AS property_city,
  application_id % 43 <> 0 AS has_pan, application_id % 47 <> 0 AS has_aadhaar, application_id % 5 <> 3 AS has_slips, application_id % 7 <> 2 AS has_form_16, application_id % 11 = 0 AS has_itr, application_id % 31 <> 0 AS has_statement, application_id % 29 <> 0 AS has_property,
  CASE WHEN application_id % 41 = 0 THEN NULL ELSE CAST(60 + application_id % 40 AS DOUBLE) / 100 END AS classification_confidence, CAST(application_id % 6 AS INT) AS n_checks, CAST(CASE WHEN application_id % 6 < 2 THEN 0 ELSE application_id % 2 + application_id % 6 - 1 END AS INT) AS n_passed,
  CAST(CASE WHEN application_id % 31 = 0 THEN 1 ELSE 0 END AS INT) AS n_bad_slips, CAST(CASE WHEN application_id % 17 = 0 THEN 2 ELSE 0 END AS INT) AS n_old_slips, CAST(CASE WHEN application_id % 37 = 0 THEN 3 ELSE 0 END AS INT) AS n_bounces, CAST(CASE WHEN application_id % 19 = 0 THEN 2 WHEN application_id % 13 = 0 THEN 1 ELSE 0 END AS INT) AS n_other,
  application_id % 19 = 0 OR application_id % 23 = 0 AS has_contradiction, CASE WHEN application_id % 2 = 0 THEN NULL ELSE application_id % 3 = 0 END AS action_matched, CASE WHEN application_id % 4 = 0 THEN NULL ELSE application_id % 10 <> 1 END AS name_correct, CASE WHEN application_id % 5 = 0 THEN NULL ELSE application_id % 8 <> 1 END AS salary_correct
FROM applications
""",
    "raw_listings": """
SELECT p_partkey AS listing_id,
  CASE p_partkey % 5 WHEN 0 THEN 'housing' WHEN 1 THEN 'magicbricks' ELSE 'square_yards' END AS source,
  CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE concat('https://listings.example/', CAST(p_partkey % 1900 AS STRING)) END AS source_url,
  p_type AS city, CASE WHEN p_partkey % 33 = 0 THEN NULL WHEN p_partkey % 45 = 0 THEN ' Whitefield' WHEN p_partkey % 46 = 0 THEN 'HSR Layout' WHEN p_partkey % 49 = 0 THEN ' ' ELSE concat('Loc ', p_brand) END AS locality,
  CASE WHEN p_partkey % 38 = 0 THEN 'studio' ELSE concat(CAST(1 + p_partkey % 4 AS STRING), ' BHK') END AS bedrooms_text,
  CASE WHEN p_partkey % 44 = 0 THEN 'area on request' ELSE concat(CAST(600 + 20 * p_size AS STRING), ' sq ft') END AS area_text,
  CASE WHEN p_partkey % 50 = 0 THEN 'price on request' WHEN p_partkey % 2 = 0
       THEN concat('Rs. ', CAST(CAST(floor(p_retailprice) AS BIGINT) * 6 * (600 + 20 * p_size) AS STRING))
       ELSE concat(CAST(20 + p_partkey % 80 AS STRING), '.5 Lakh') END AS price_text,
  CASE p_partkey % 6 WHEN 0 THEN 'Residential Flat' WHEN 1 THEN 'Villa' WHEN 2 THEN 'Independent House' WHEN 3 THEN 'Plot of land' ELSE 'apartment' END AS property_type_text,
  CASE WHEN p_partkey % 12 = 0 THEN 'For Rent' ELSE 'For Sale' END AS transaction_text,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1 + p_size % 3 AS INT) END AS bathrooms,
  CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CAST(1 + p_size % 12 AS INT) END AS total_floors,
  CASE WHEN p_partkey % 7 = 0 THEN 'Furnished' WHEN p_partkey % 7 = 1 THEN '' END AS furnishing, CASE WHEN p_partkey % 5 = 0 THEN CAST(1 + p_size % 9 AS INT) END AS floor,
  CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size % 4 AS INT) END AS property_age, CASE WHEN p_partkey % 8 = 0 THEN CAST(p_size % 3 AS INT) END AS parking,
  CASE WHEN p_partkey % 9 = 0 THEN '560001' END AS pincode, CASE WHEN p_partkey % 77 = 0 THEN NULL ELSE CAST(p_partkey % 200 AS INT) END AS listing_age_days
FROM part
""",
    "listing_pages": """
SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN 'https://x.example/flat-npd-' WHEN 1 THEN 'https://x.example/property-card/' WHEN 2 THEN 'https://x.example/projects/flat-npd-' ELSE url END, CAST(page_id AS STRING)) AS url,
  concat(html, CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json">{"offers": {"price": ', CAST(4000000 + page_id AS STRING), '}, "address": {"addressLocality": "Lake View", "postalCode": "560066"}}</script>') ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN concat('<script id="__NEXT_DATA__" type="application/json">{"address": {"addressLocality": "Hill ', CAST(page_id % 9 AS STRING), '"}}</script>') ELSE '' END,
    CASE WHEN page_id % 2 = 0 THEN concat('<div>', CAST(1 + page_id % 4 AS STRING), ' BHK flat of <b>1,', CAST(100 + page_id % 800 AS STRING), '</b> sq.ft. at ₹1.', CAST(page_id % 9 AS STRING), ' Cr, 2 Bath, ', CASE page_id % 5 WHEN 0 THEN 'Semi-Furnished' WHEN 2 THEN 'Unfurnished' ELSE 'Furnished' END, ' furnished, Floor: ', CAST(page_id % 12 AS STRING), ', Total Floors: 14, Property Age: ', CAST(page_id % 20 AS STRING), ', 1 Car Parking, PIN 560', CAST(100 + page_id % 800 AS STRING), '</div>') ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN concat(chr(10), 'PRM/KA/RERA/1251/446/PR/1710', CAST(page_id % 10 AS STRING), '/00', CAST(page_id AS STRING), chr(10), 'Project Name: Lake Park', chr(10), 'Builder: Acme Homes', chr(10), 'Total Units: ', CAST(page_id % 300 AS STRING), chr(10), 'Completion Date: 2025-06-30', chr(10)) ELSE '' END,
    CASE WHEN page_id % 11 = 0 THEN '<p>Access Denied</p>' WHEN page_id % 13 = 0 THEN '<p>please solve the CAPTCHA</p>' ELSE '' END) AS html
FROM pages
""",
    "rich_pages": """
SELECT page_id, concat('<html><head>', CASE page_id % 5 WHEN 0 THEN '<meta name="description" content="2 BHK flat in Lake View, Pune">' WHEN 1 THEN '<title>Flats at Hill Road | Example</title>' ELSE '<title>A page</title>' END, '</head><body>',
    CASE WHEN page_id % 6 = 2 THEN '<nav><a href="/">Home</a> <a href="/p">Projects in <b>Sea</b> Side</a></nav>' WHEN page_id % 6 = 4 THEN '<ul class="top breadcrumb"><a>Property</a><a>Properties in Old Town</a></ul>' ELSE '' END,
    CASE WHEN page_id % 2 = 0 THEN concat('<script type="application/ld+json">[{"name": "A', CAST(page_id AS STRING), '", "address": {"addressLocality": "Lake", "postalCode": "560066"}}, {"offers": {"price": ', CAST(4000000 + page_id AS STRING), '}}, 7]</script>') ELSE '' END,
    CASE WHEN page_id % 3 = 0 THEN concat('<script type="application/ld+json">{"address": {"addressLocality": "Hill ', CAST(page_id % 4 AS STRING), '"}, "geo": {"lat": 1}}', chr(10), '{"geo": {"lon": 2, "at": {"x": 1}}, "tags": ["x", "y"]}</script>') ELSE '' END,
    CASE WHEN page_id % 4 = 1 THEN '<script type="application/ld+json">{"name": "broken" "x"}</script><script type="application/ld+json">no object</script>' ELSE '' END,
    CASE WHEN page_id % 5 = 2 THEN '<script id="__NEXT_DATA__" type="application/json">{"props": {"page": {"id": 7, "city": "Pune"}}, "address": "none", "geo": {"at": {"y": 2}}}</script>' ELSE '' END,
    CASE WHEN page_id % 7 = 0 THEN '<script>window.__NUXT__ = {"props": {"page": {"city": "Erode"}}, "tags": {"k": 1}};</script>' ELSE '' END,
    CASE WHEN page_id % 4 < 2 THEN concat('<div>2 BHK of 1,', CAST(100 + page_id % 800 AS STRING), ' sq.ft. for ₹ 1.', CAST(page_id % 9 AS STRING), ' Cr <p>3 BHK: 1500 sqft, ₹95 Lakh</p> 4 BHK 2,000 sq. feet on request ... 1 BHK 600 sq ft ₹40,', CAST(page_id % 9 AS STRING), ' Lac</div>') ELSE '' END, '</body></html>') AS html
FROM pages
""",
    "subjects": """
SELECT o_orderkey AS application_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'LARGE' WHEN 3 THEN 'PROMO' WHEN 4 THEN 'SMALL' ELSE 'ECONOMY' END AS city,
  concat('Loc Brand#', CAST(1 + o_orderkey % 25 AS STRING)) AS locality,
  CASE WHEN o_custkey % 61 = 0 THEN NULL ELSE CAST(1 + o_custkey % 4 AS INT) END AS bhk, CASE WHEN o_custkey % 67 = 0 THEN NULL ELSE CAST(600 + 20 * (o_custkey % 50) AS DOUBLE) END AS area_sqft,
  CASE o_custkey % 5 WHEN 0 THEN 'Residential Flat' WHEN 1 THEN 'villa' WHEN 2 THEN 'Independent House' WHEN 3 THEN 'Plot' ELSE 'apartment' END AS property_type
FROM orders
""",
    "audit_log": """
SELECT event_id AS seq, ts, user_id AS application_id,
  CASE event_type WHEN 'purchase' THEN 'APPROVE' WHEN 'error' THEN 'DENY' WHEN 'signup' THEN 'APPROVE' ELSE 'SUSPEND' END AS decision,
  CASE event_type WHEN 'view' THEN 'low_confidence' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'critical_compliance' ELSE NULL END ELSE NULL END AS gate_triggered,
  CAST(50 + event_id % 50 AS DOUBLE) / 100 AS confidence,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'APPROVE' ELSE 'SUSPEND' END AS underwriter_rec,
  CASE WHEN event_id % 4 = 0 THEN 'APPROVE' ELSE 'SUSPEND' END AS analyst_rec
FROM events
""",
    "doc_texts": """
SELECT application_id, 'SALARY_SLIP' AS true_type, concat('salary_', CAST(application_id AS STRING), '.pdf') AS filename,
  concat('Payslip for ', CASE application_id % 9 WHEN 0 THEN 'January 2024' WHEN 1 THEN '07/2024' WHEN 2 THEN 'Mayy 2024' ELSE 'May 2024' END, chr(10), 'Basic Pay: ', CAST(CAST(floor(monthly_income / 2) AS BIGINT) AS STRING), '.00', chr(10), 'Employee Name: ', name, chr(10), 'Employee ID: E', CAST(application_id AS STRING), chr(10),
    'Gross Salary: ', CAST(CAST(monthly_income AS BIGINT) AS STRING), chr(10), 'Total Deductions: ', CAST(CAST(monthly_income AS BIGINT) / 10 AS STRING), chr(10),
    'Net Pay: ', CAST(CASE WHEN application_id % 31 = 0 THEN CAST(monthly_income AS BIGINT) ELSE CAST(monthly_income AS BIGINT) - CAST(floor(monthly_income / 10) AS BIGINT) END AS STRING), chr(10), 'Provident Fund') AS text
FROM applications
UNION ALL
SELECT application_id, 'PAN_CARD', concat('doc_', CAST(application_id AS STRING), '.pdf'),
  concat('INCOME TAX DEPARTMENT', chr(10), 'Permanent Account Number', chr(10), form_pan, chr(10), 'Name: ', name, chr(10), 'Date of Birth 12/03/1985')
FROM case_inputs WHERE pan_present
UNION ALL
SELECT application_id, 'AADHAAR_CARD', concat('aadhaar_', CAST(application_id AS STRING), '.pdf'),
  concat('Government of India', chr(10), 'Name: ', aadhaar_name, chr(10), 'DOB: 1', CAST(application_id % 9 AS STRING), '/02/1985', chr(10), CASE WHEN application_id % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END, chr(10),
    CASE WHEN application_id % 3 = 0 THEN 'XXXX-XXXX-' ELSE '2345 6789 ' END, CAST(1000 + application_id % 9000 AS STRING), chr(10), 'Address: Flat ', CAST(application_id % 90 AS STRING), ', Lake Road, ', coalesce(nullif(trim(city), ''), 'Erode'), chr(10), 'Pin 5600', CAST(10 + application_id % 80 AS STRING))
FROM case_inputs WHERE aadhaar_present AND application_id % 5 = 0
UNION ALL
SELECT application_id, 'FORM_16', concat('form16_', CAST(application_id AS STRING), '.pdf'),
  concat('FORM NO. 16', chr(10), 'TAN of the deductor: ABCD', lpad(CAST(application_id % 100000 AS STRING), 5, '0'), 'E', chr(10), 'Employer Name: Acme Finance', chr(10), 'PAN of the employee: ', form_pan, chr(10), 'Employee Name: ', name, chr(10), 'Assessment Year: 2024-25', chr(10),
    'Financial Year: ', CASE WHEN application_id % 4 = 0 THEN '2022-23' ELSE '2023-24' END, chr(10), 'Gross Salary as per section 17: Rs. ', CAST(CAST(monthly_income AS BIGINT) * 12 AS STRING), '.00', chr(10), 'Total Tax Deducted: ', CAST(CAST(floor(monthly_income / 10) AS BIGINT) AS STRING))
FROM case_inputs WHERE application_id % 6 = 0
UNION ALL
SELECT application_id, 'ITR', concat('tax_return_', CAST(application_id AS STRING), '.pdf'),
  concat('Indian Income Tax Return ITR-', CAST(1 + application_id % 4 AS STRING), chr(10), 'Acknowledgement Number: 12345', lpad(CAST(application_id AS STRING), 9, '0'), chr(10), 'PAN ', form_pan, chr(10), 'AY 2024-25', chr(10), 'Gross Total Income: INR ', CAST(CAST(monthly_income AS BIGINT) * 11 AS STRING), '.50', chr(10), 'Total Deductions 15,000.00', chr(10), 'Taxes Paid: ', CAST(application_id % 7000 AS STRING))
FROM case_inputs WHERE application_id % 8 = 0
UNION ALL
SELECT application_id, 'BANK_STATEMENT', concat('stmt_', CAST(application_id AS STRING), '.pdf'),
  concat(CASE application_id % 3 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'Canara Bank' ELSE 'Village Bank' END, ' Account Statement', chr(10), 'Account Holder Name: ', name, chr(10), 'Account Number: 12345', lpad(CAST(application_id AS STRING), 8, '0'), chr(10), 'IFSC Code: HDFC0', lpad(CAST(application_id % 1000000 AS STRING), 6, '0'), chr(10),
    'Statement Period: 01/01/2024 to 30/06/2024', chr(10), CASE WHEN application_id % 4 = 0 THEN concat('05/01/2024 SALARY CREDIT', chr(10), CASE WHEN application_id % 8 = 0 THEN 'ref 0.00 77.50' ELSE 'ref 77' END, chr(10), '55,', CAST(100 + application_id % 900 AS STRING), '.00')
      ELSE concat('05/01/2024 ACH SALARY 0.00 62,', CAST(100 + application_id % 900 AS STRING), '.00 210,000.00', chr(10), '07/01/2024 HOME LOAN EMI 12,', CAST(100 + application_id % 900 AS STRING), '.50 150,000.00', chr(10), '05/02/2024 PAYROLL 61,000.00') END, chr(10), '09/02/2024 UPI TEA 40.00', chr(10), 'Closing Balance: Rs. 9', CAST(application_id % 1000 AS STRING), '.25')
FROM case_inputs WHERE application_id % 7 = 0
UNION ALL
SELECT application_id, 'PROPERTY_DEED', concat('scan_', CAST(application_id AS STRING), '.pdf'),
  concat(CASE application_id % 3 WHEN 0 THEN 'ALLOTMENT LETTER' WHEN 1 THEN 'SALE DEED' ELSE 'Agreement for Sale' END, chr(10), 'Purchaser: ', name, chr(10), 'Vendor: Acme Builders', chr(10), 'Property Address: 12 Lake Road, Whitefield, ', CASE WHEN application_id % 2 = 0 THEN 'Pune' ELSE 'Erode' END, ', 560066', chr(10),
    CASE WHEN application_id % 5 = 0 THEN 'Plot Area: 1,200 Sq. Ft.' ELSE 'Super Built-up Area: 1,450.5 Sq. Ft.' END, chr(10), 'Consideration Amount: INR ', CAST(CAST(floor(property_value) AS BIGINT) AS STRING), chr(10), 'Registration No: REG/', CAST(application_id AS STRING))
FROM case_inputs WHERE application_id % 9 = 0
UNION ALL
SELECT application_id, 'OTHER', concat('note_', CAST(application_id AS STRING), '.txt'), 'A letter without any mark.' FROM applications WHERE application_id % 50 = 0
""",
    "scanned_texts": """
SELECT application_id, 'PAN_CARD' AS doc_class, concat('card_', CAST(application_id AS STRING), '.png') AS filename,
  CASE WHEN application_id % 4 = 0 THEN concat('INCOME TAX DEPARTMENT', chr(10), 'GOVT. OF INDIA', chr(10), ' ', upper(name), chr(10), 'RAJ SINGH', chr(10), '12/03/1985', chr(10), 'x', form_pan, chr(10), form_pan)
       WHEN application_id % 4 = 1 THEN concat(form_pan, chr(10), 'Father''s Name: Ram Dev', chr(10), 'Name: ', name, chr(10), 'DOB: 02-04-1979')
       WHEN application_id % 4 = 2 THEN concat('Signature', chr(10), 'Govt. of India') ELSE NULL END AS text
FROM case_inputs WHERE application_id % 3 = 0
UNION ALL
SELECT application_id, 'AADHAAR_CARD', concat('uid_', CAST(application_id AS STRING), '.png'),
  concat('Government of India', chr(10), CASE WHEN application_id % 6 < 3 THEN concat(aadhaar_name, chr(10)) ELSE '' END, 'DOB: 0', CAST(1 + application_id % 9 AS STRING), '/02/1985', chr(10), CASE application_id % 3 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'Transgender' ELSE 'n/a' END, chr(10), '2345 6789 ', CAST(1000 + application_id % 9000 AS STRING), chr(10),
    CASE application_id % 4 WHEN 0 THEN concat('Address:', chr(10), '12 Lake Side', chr(10), 'Erode 638001') WHEN 1 THEN ' Flat 4, MG Road, Pune 411001' WHEN 2 THEN 'Address - 77 Hill View, Vellore' ELSE 'Pin 560001' END)
FROM case_inputs WHERE application_id % 4 <> 3 OR application_id % 5 = 0
UNION ALL
SELECT application_id, 'BANK_STATEMENT', concat('bank_', CAST(application_id AS STRING), '.txt'),
  concat(CASE application_id % 3 WHEN 0 THEN 'Statement of sbi' ELSE 'Village Bank' END, chr(10), CASE application_id % 4 WHEN 0 THEN concat('Name: ', name) WHEN 1 THEN 'Name: Axis Branch' WHEN 2 THEN concat('Customer Name', chr(10), name) ELSE '' END, chr(10),
    'A/C No. 12345', lpad(CAST(application_id AS STRING), 8, '0'), chr(10), CASE WHEN application_id % 5 = 0 THEN '' ELSE 'IFSC SBIN0123456' END, chr(10),
    CASE application_id % 6 WHEN 0 THEN 'Inward Cheque Returns: 2' WHEN 1 THEN concat('01/02/2024 ECS BOUNCE 500.00', chr(10), '09/03/2024 nach return 200.00', chr(10), 'CHEQUE RETURN COUNT: 0') WHEN 2 THEN 'Bounce Count 0' ELSE '02/02/2024 UPI 20.00' END, chr(10),
    CASE application_id % 7 WHEN 0 THEN concat('05/02/2024 SALARY CREDIT', chr(10), 'ref 0.00 77.50', chr(10), '61,000.00') WHEN 1 THEN '05/02/2024 PAYROLL 0.00' WHEN 2 THEN 'Closing Balance: 12,000.50' WHEN 3 THEN '05/02/2024 ach salary 0.00 70,000.00' ELSE '' END)
FROM case_inputs WHERE application_id % 5 < 3
UNION ALL
SELECT application_id, 'PROPERTY_DEED', concat('deed_', CAST(application_id AS STRING), '.pdf'),
  concat(CASE application_id % 2 WHEN 0 THEN 'Possession Letter' ELSE 'Deed' END, chr(10), 'In favour of', chr(10), name, chr(10), 'Builder: Acme & Sons', chr(10),
    CASE application_id % 4 WHEN 0 THEN concat('Property Address:', chr(10), '12 Lake Road,', chr(10), 'Whitefield, Pune, 560066', chr(10), 'Super Built-up Area: 1,450.5 Sq. Ft.', chr(10)) WHEN 1 THEN concat('Property Address: 7 Hill St, Adyar, Chennai', chr(10)) WHEN 2 THEN concat('PROPERTY ADDRESS 9 Sea View, Erode', chr(10)) ELSE '' END,
    CASE WHEN application_id % 3 = 0 THEN 'Sale Consideration Rs. 45,00,000' ELSE 'Consideration 0' END)
FROM case_inputs WHERE application_id % 7 = 1
""",
    "bank_credits": """
SELECT l_orderkey AS application_id, l_linenumber AS line_no, l_shipdate AS tx_ts, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 'ACH SALARY CREDIT' WHEN l_returnflag = 'A' THEN 'HOME LOAN EMI' ELSE 'UPI TRANSFER' END AS narration,
  l_extendedprice AS amount
FROM lineitem
""",
}


def _reads(name: str) -> list[str]:
    """The views that a view reads."""
    return [x for x in VIEWS if x != name and re.search(rf"\b(FROM|JOIN)\s+{x}\b", VIEWS[name])]


def needed(*names: str) -> list[str]:
    """The views to create for the named ones, in order."""
    found: list[str] = []
    for name in names:
        for x in (*needed(*_reads(name)), name):
            if x not in found:
                found.append(x)
    return found


_made: dict[tuple[str, str], DataFrame] = {}


def _named(sql: str, prefix: str) -> str:
    """sql with the tables and views it reads under their names in the session."""
    return re.sub(r"\b(FROM|JOIN)(\s+)(\w+)", lambda m: m[1] + m[2] + (prefix if m[3] in TABLES or m[3] in VIEWS else "") + m[3], sql)


def _make(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Makes a table or view in the session once, under a name of its own; gives the prefix of that name."""
    prefix = f"loanloom_{zlib.crc32(sf_dir.encode()):08x}_"
    key = (spark.sparkContext.applicationId + str(id(spark._jsparkSession)), prefix + name)
    if key not in _made:
        if name in TABLES:
            _made[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            for x in {m[3] for m in re.finditer(r"\b(FROM|JOIN)(\s+)(\w+)", VIEWS[name]) if m[3] in TABLES or m[3] in VIEWS}:
                _make(spark, sf_dir, x)
            _made[key] = spark.sql(_named(VIEWS[name], prefix))
        _made[key].createOrReplaceTempView(prefix + name)
    return prefix


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view or a given table as a DataFrame."""
    return spark.table(_make(spark, sf_dir, name) + name)


def once(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """make, building its DataFrame once for a session and folder. Nothing is computed or held but the plan."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId + str(id(spark._jsparkSession)), f"{make.__module__}.{make.__name__} {sf_dir}")
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return get


def query(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The rows of sql over the named fixture views and tables."""
    for name in names:
        prefix = _make(spark, sf_dir, name)
    return spark.sql(_named(sql, prefix))


def oracle(sql: str, *names: str, **more: str) -> str:
    """sql after the fixture views it uses and further named queries, as one statement."""
    parts = [f"{x} AS ({VIEWS[x]})" for x in needed(*names)] + [f"{x} AS ({q})" for x, q in more.items()]
    return f"WITH {', '.join(parts)} {sql}"
