"""Declared schemas of the six input tables.

Fixed values: column names follow the exports. Money is DECIMAL(18,2), keys and
postal codes are text, rates are doubles.
"""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "subscriptions": """
        customer_id STRING, plan STRING, billing_cycle STRING, industry STRING,
        company_size STRING, seats INT, monthly_revenue DECIMAL(18,2),
        acquisition_channel STRING, region STRING, signup_date STRING, churned STRING,
        churn_date STRING, churn_reason STRING, support_tickets_12mo INT, nps_score INT,
        feature_usage_pct INT, upgraded STRING""",
    "monthly_revenue": """
        month STRING, total_active_customers INT, new_customers INT, churned_customers INT,
        monthly_churn_rate_pct DOUBLE, total_mrr DECIMAL(18,2),
        avg_revenue_per_customer DECIMAL(18,2), customer_acquisition_cost DECIMAL(18,2)""",
    "orders": """
        order_id STRING, order_date STRING, product_id STRING, category STRING, channel STRING,
        quantity INT, unit_price DECIMAL(18,2), gross_revenue DECIMAL(18,2),
        discount_amount DECIMAL(18,2), shipping_cost DECIMAL(18,2), platform_fee DECIMAL(18,2),
        is_returned STRING, return_reason STRING, return_processing_cost DECIMAL(18,2)""",
    "products": """
        product_id STRING, category STRING, product_name STRING, unit_cost DECIMAL(18,2),
        list_price DECIMAL(18,2)""",
    "marketing_spend": """
        month STRING, platform STRING, spend DECIMAL(18,2), impressions BIGINT, clicks BIGINT,
        conversions BIGINT, attributed_revenue DECIMAL(18,2)""",
    "crashes": """
        `CRASH DATE` STRING, `CRASH TIME` STRING, `BOROUGH` STRING, `ZIP CODE` STRING,
        `LATITUDE` DOUBLE, `LONGITUDE` DOUBLE, `ON STREET NAME` STRING,
        `CROSS STREET NAME` STRING, `NUMBER OF PERSONS INJURED` INT,
        `NUMBER OF PERSONS KILLED` INT, `NUMBER OF PEDESTRIANS INJURED` INT,
        `NUMBER OF PEDESTRIANS KILLED` INT, `NUMBER OF CYCLIST INJURED` INT,
        `NUMBER OF CYCLIST KILLED` INT, `NUMBER OF MOTORIST INJURED` INT,
        `NUMBER OF MOTORIST KILLED` INT, `CONTRIBUTING FACTOR VEHICLE 1` STRING,
        `CONTRIBUTING FACTOR VEHICLE 2` STRING, `VEHICLE TYPE CODE 1` STRING,
        `VEHICLE TYPE CODE 2` STRING, `COLLISION_ID` BIGINT""",
    "transactions": """
        InvoiceNo STRING, InvoiceDate DATE, CustomerID STRING, ProductCategory STRING,
        Quantity INT, UnitPrice DECIMAL(18,2), Channel STRING, Country STRING""",
}

# Export header to snake_case name.
CRASH_COLUMNS: dict[str, str] = {
    "CRASH DATE": "crash_date_text",
    "CRASH TIME": "crash_time",
    "BOROUGH": "borough",
    "ZIP CODE": "zip_code",
    "LATITUDE": "latitude",
    "LONGITUDE": "longitude",
    "ON STREET NAME": "on_street",
    "CROSS STREET NAME": "cross_street",
    "NUMBER OF PERSONS INJURED": "persons_injured",
    "NUMBER OF PERSONS KILLED": "persons_killed",
    "NUMBER OF PEDESTRIANS INJURED": "pedestrians_injured",
    "NUMBER OF PEDESTRIANS KILLED": "pedestrians_killed",
    "NUMBER OF CYCLIST INJURED": "cyclists_injured",
    "NUMBER OF CYCLIST KILLED": "cyclists_killed",
    "NUMBER OF MOTORIST INJURED": "motorists_injured",
    "NUMBER OF MOTORIST KILLED": "motorists_killed",
    "CONTRIBUTING FACTOR VEHICLE 1": "contributing_factor_1",
    "CONTRIBUTING FACTOR VEHICLE 2": "contributing_factor_2",
    "VEHICLE TYPE CODE 1": "vehicle_type_1",
    "VEHICLE TYPE CODE 2": "vehicle_type_2",
    "COLLISION_ID": "collision_id",
}
