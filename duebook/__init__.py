"""duebook: accounts-receivable analytics as Spark DataFrame operators."""
