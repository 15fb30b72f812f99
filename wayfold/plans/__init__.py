"""Named queries over the driver tables, with the SQL that they are held against."""
