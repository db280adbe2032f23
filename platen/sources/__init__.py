"""Reading and writing: archives, document scans, package files, the driver-table views."""
