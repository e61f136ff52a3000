"""DataFrame operators. Times are whole hours (or any whole step) on a long axis unless said otherwise; a row at t covers
the step that ends at t. Null is unknown; an absent row is dry."""
